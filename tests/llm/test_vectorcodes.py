"""Operator 12 against plain rounds in whole numbers: ties, odd vectors, what the bounds rule out."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from partledger.llm import vectorcodes as V
from partledger.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int"


def nearest(x, book):
    d = [sum((a - b) ** 2 for a, b in zip(x, y, strict=True)) for y in book]
    return d.index(min(d)), min(d)


def brute_force(rows, parts, entries, rounds):
    kept = [(i, tuple(math.floor(256 * float(np.float32(x))) for x in v)) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    size = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * size : (p + 1) * size]
    first = {}
    for i, v in kept:
        first[i] = min(v, first.get(i, v))
    ids = sorted(first, key=lambda i: (i is None, i))[:entries]
    books = [[cut(first[i], p) for i in ids] for p in range(parts)]
    for _ in range(rounds):
        for p, book in enumerate(books):
            at = [nearest(cut(v, p), book)[0] for _, v in kept]
            for e in range(len(book)):
                mine = [cut(v, p) for (_, v), a in zip(kept, at, strict=True) if a == e]
                if mine:
                    book[e] = tuple(sum(c) // len(mine) for c in zip(*mine, strict=True))
    out = []
    for i, v in kept:
        best = [nearest(cut(v, p), book) for p, book in enumerate(books)]
        out.append((i, bytes(b[0] for b in best), sum(b[1] for b in best)))
    return sorted(out, key=str), books


def coarse(rnd, n, size, repeats):
    """Vectors on a coarse grid, so that ties and repeated rows are many."""
    rows = [(rnd.randint(-20, 20), [rnd.choice([-1.0, -0.5, 0.0, 0.25, 1.0]) for _ in range(size)]) for _ in range(n)]
    return rows + [rnd.choice(rows) for _ in range(repeats)]


@pytest.mark.parametrize(("entries", "rounds", "refresh"), [(5, 2, 4), (64, 2, 4), (7, 6, 2), (1, 3, 1), (9, 0, 1)])
def test_codes_match_plain_rounds(spark, entries, rounds, refresh):
    rnd = random.Random(entries)
    rows = coarse(rnd, 150, 8, 40) + [(None, [0.1] * 8), (99, [rnd.gauss(0, 3) for _ in range(8)])]
    odd = [(50, None), (51, [0.0] * 7 + [None]), (52, [0.0] * 7 + [math.nan]), (-90, [math.inf] + [0.0] * 7)]
    given = spark.createDataFrame([(i, v, 1) for i, v in rows + odd], SCHEMA).withColumn("code", F.lit("x")).withColumn("_x", F.lit(1))
    codes, books = V.vector_codes(given.repartition(3), parts=4, entries=entries, rounds=rounds, refresh=refresh)
    want, want_books = brute_force(rows + odd, 4, entries, rounds)
    assert sorted(((r.vec_id, bytes(r.code), r.error) for r in codes.collect()), key=str) == want
    assert books.tolist() == [[list(e) for e in book] for book in want_books]


def test_bounds_rule_out_most_distances_and_no_nearest_one():
    rnd = np.random.default_rng(5)
    x = np.floor(rnd.normal(size=(3000, 2, 4)) * 256).astype(np.int64)
    start = x[:64].transpose(1, 0, 2)
    entry, upper, above = V.Codebooks(start, start).first(x)
    shape = above.shape[1:]
    assert (V.unpacked(V.packed(above), shape) == above).all()
    now = start + rnd.integers(-60, 60, start.shape)
    books = V.Codebooks(start, now)
    found, error, taken, lowers = books.assign(x, entry, upper, above)
    d = ((x[:, :, None] - now[None]) ** 2).sum(-1)
    assert (found == d.argmin(-1)).all() and (error == d.min(-1)).all() and taken < 0.5 * d.size
    for p, lower in enumerate(lowers):
        assert (lower <= np.sqrt(d[:, p]) * (1 + V.SLACK) + V.SLACK).all()


def test_other_lengths_get_no_code(spark):
    rows = [(1, [0.0, 1.0, 2.0, 3.0], 1), (2, [0.0, 1.0], 1), (3, [], None), (4, [1.0, 1.0, 1.0], None), (5, [0.0, 1.0, 2.0, 4.0], 2)]
    codes, books = V.vector_codes(spark.createDataFrame(rows, SCHEMA), parts=2, entries=2, rounds=1)
    assert {r.vec_id: (r.code and bytes(r.code), r.error) for r in codes.collect()} == {1: (b"\0\0", 0), 5: (b"\0\1", 0), 2: (None, None), 3: (None, None), 4: (None, None)}
    assert books.tolist() == [[[0, 256], [0, 256]], [[512, 768], [512, 1024]]]
    codes, books = V.vector_codes(spark.createDataFrame(rows, SCHEMA).limit(0))
    assert codes.count() == 0 and books.shape == (16, 0, 0)


def test_too_large_components_are_an_error(spark):
    with pytest.raises(Exception, match="too large"):
        V.vector_codes(spark.createDataFrame([(1, [3e38] * 16, 1)], SCHEMA))[0].collect()


def test_query_sums_errors_by_label(spark, tmp_path):
    rnd = random.Random(8)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(64)], rnd.choice([None, 0, 1])) for i in range(200)] + [(3, None, 1), (7, [1.0] * 64, None)]
    spark.createDataFrame(rows, SCHEMA).withColumn("extra", F.lit(1)).write.parquet(f"file://{tmp_path}/embeddings.parquet")
    got = QUERIES["op12_vector_codes"](spark, f"file://{tmp_path}").collect()
    want, books = brute_force([(i, v) for i, v, _ in rows], 16, 64, 2)
    assert sorted(((r.vec_id, bytes.fromhex(r.code), r.error) for r in got), key=str) == want
    label = {(i, tuple(v)): n for i, v, n in rows if v}
    assert len(label) == len(got) and {r.codebooks_sha256 for r in got} == {V.codebooks_digest(np.array(books))}
    totals = {}
    for (i, _), n in label.items():
        totals.setdefault(n, []).append(i)
    assert sorted({r.label_error for r in got}) == sorted({r.label_error for r in got if r.vec_id in {x[0] for x in totals.values()}})
    assert sum({r.label_error for r in got}) == sum(r.error for r in got)


def test_query_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"file://{tmp_path}/embeddings.parquet")
    assert QUERIES["op12_vector_codes"](spark, f"file://{tmp_path}").count() == 0
