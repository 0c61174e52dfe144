"""Operator 13 against brute force: every period of every text, odd rows, long texts."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from partledger.llm import periodic
from partledger.llm.queries import QUERIES


def brute_force(w, times=4, least=6):
    found = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def repetitive(rnd):
    letters, w = rnd.choice([1, 2, 2, 3, 4]), []
    for _ in range(rnd.randint(0, 8)):
        w += [rnd.randrange(letters) for _ in range(rnd.randint(1, 5))] * rnd.randint(1, 7)
        if w and rnd.random() < 0.3:
            a = rnd.randrange(len(w))
            w += w[a : a + rnd.randint(1, 40)]
    return [b"%d" % x for x in w]


@pytest.mark.parametrize(("times", "least"), [(4, 6), (2, 2), (3, 5)])
def test_runs_match_brute_force(times, least):
    rnd = random.Random(times)
    for _ in range(300):
        texts = [repetitive(rnd) for _ in range(rnd.randint(0, 5))]
        assert periodic.runs_of_texts(texts, times, least) == [brute_force(w, times, least) for w in texts]


def test_extensions_and_longest_previous_factors():
    import numpy as np

    rnd = random.Random(3)
    for _ in range(50):
        x = [rnd.randrange(2) for _ in range(rnd.randint(0, 30))] + [9]
        factors = periodic.Factors(np.array(x))
        assert [x[i:] for i in factors.order] == sorted(x[i:] for i in range(len(x)))
        common = lambda a, b: next((k for k in range(len(x)) if b + k >= len(x) or x[a + k] != x[b + k]), 0)  # noqa: B023, E731
        length, source = factors.previous()
        assert length == [max((common(j, i) for j in range(i)), default=0) for i in range(len(x))]
        assert all(common(source[i], i) == length[i] for i in range(len(x)) if length[i])


def test_odd_rows(spark):
    long = "go " * 30000 + "x " + "a b\n" * 20000
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a " * 6), (4, "a " * 6), (None, "a b\ta b a\nb a b end"), (5, "a a a a a"), (6, long), (7, "é ñ " * 5 + "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit("x")).withColumn("n_words", F.lit(1)).withColumn("key", F.lit(2))
    got = sorted(periodic.periodic_runs(docs).collect(), key=lambda r: (r.doc_id or 0, r.n_words))
    assert [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed, r.key) for r in got] == [
        (None, 9, [(0, 8, 2)], "a b end", 2), (1, 0, [], "", 2), (2, 0, [], "", 2), (3, 0, [], "", 2), (4, 6, [(0, 6, 1)], "a", 2), (4, 6, [(0, 6, 1)], "a", 2), (5, 5, [], "a a a a a", 2),
        (6, 70001, [(0, 30000, 1), (30001, 40000, 2)], "go x a b", 2), (7, 11, [(0, 10, 2)], "é ñ z", 2),
    ]
    assert periodic.periodic_runs(docs.limit(0)).count() == 0


def test_greatest_exponent_takes_the_first_of_equals(spark):
    runs = "array(named_struct('start', 0L, 'length', 8L, 'period', 2L), named_struct('start', 9L, 'length', 13L, 'period', 3L), named_struct('start', 30L, 'length', 26L, 'period', 6L))"
    got = spark.range(1).select(periodic.greatest_exponent(F.expr(runs)).alias("x"), periodic.greatest_exponent(F.expr(f"slice({runs}, 1, 0)")).alias("none")).first()
    assert tuple(got.x) == (9, 13, 3) and got.none is None


def test_planted_texts(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(i % 37))) for i in range(300)] + [(None, "a b"), (7, None)]
    got = {(r.doc_id, r.text) for r in periodic.planted(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = set()
    for i, text in rows:
        h = None if i is None else zlib.crc32(str(i).encode())
        if text and h is not None and h % 10 == 0:
            w, g = text.split(), h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            text = " ".join(x if k < a else w[a + (k - a) % p] for k, x in enumerate(w))
        want.add((i, text))
    assert got == want


def test_query_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{tmp_path}/documents.parquet")
    assert QUERIES["op13_periodic_runs"](spark, f"file://{tmp_path}").count() == 0
