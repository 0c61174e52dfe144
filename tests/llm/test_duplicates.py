"""Operators 6 and 8 and the components on small fixtures, against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from partledger.llm import linededup, minhash
from partledger.llm.components import components

SCHEMA = "doc_id long, text string"


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c < "\x80" else c for c in text or ""))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def roots(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute_components(rows, n):
    sets = {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, []).append(shingles(t, n))
    links = [(i, j) for i in sets for j in sets if i < j for a in sets[i] for b in sets[j] if a and b and 100 * len(a & b) >= 80 * len(a | b)]
    return roots(sets, links)


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(50)] + [(7, 7), (300, 299)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = roots({x for p in links for x in p}, links)
    assert got == want


def test_components_of_long_chains(spark):
    rng = random.Random(6)
    for n, near in ((500, 1), (300, 2)):
        ids = rng.sample(range(10 * n), n)
        links = [(ids[i], ids[i + k]) for k in range(1, near + 1) for i in range(n - k)]
        got = components(spark.createDataFrame(links, "a long, b long")).collect()
        assert len(got) == n and {r.component for r in got} == {min(ids)}
    assert components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


def copies(seed, groups, each, edits):
    rng = random.Random(seed)
    rows, i = [], 0
    for _ in range(groups):
        base = [f"w{rng.randint(0, 500)}" for _ in range(rng.randint(20, 80))]
        for _ in range(each):
            w = list(base)
            for _ in range(rng.randint(0, edits)):
                w[rng.randrange(len(w))] = f"x{rng.randint(0, 500)}"
            rows.append((i, " ".join(w)))
            i += 1
    return rows


def families(seed, n, each, edits, size=60):
    """Two families whose bases share a part, each with loose variants."""
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 500)}" for _ in range(size)]
    other = base[: 3 * size // 4] + [f"v{rng.randint(0, 500)}" for _ in range(size // 4)]
    rows = []
    for k in range(n * each):
        w = list(base if k % 3 else other)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"x{rng.randint(0, 40)}"
        rows.append((k, " ".join(w)))
    return rows


def test_near_duplicates_match_brute_force(spark):
    for n, pairs, rows in ((5, 32, copies(2, 8, 10, 2)), (2, 4, copies(1, 12, 8, 4) + [(200 + i, t) for i, t in families(4, 1, 110, 9)])):
        rows = rows + [(900, None), (901, ""), (902, " \t"), (903, "One"), (904, "one"), (905, rows[3][1].upper()), (None, "lonely null id"), rows[3], (906, "Word " * 30000)]
        docs = spark.createDataFrame(rows, SCHEMA).withColumn("rep", F.lit("clash")).withColumn("bucket", F.lit("clash"))
        got = minhash.near_duplicates(docs, shingle=n, pairs=pairs).collect()
        want = brute_components(rows, n)
        assert len(got) == len(rows)
        sizes = {}
        for i, t in rows:
            sizes.setdefault(i, set()).add(len(shingles(t, n)))
        for r in got:
            assert r.n_shingles in sizes[r.doc_id]
            if r.doc_id is not None:
                assert r.component_id == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_differences_from_a_centre_give_all_links(spark):
    """All of a group's links, found without bands: the components equal those of all pairs."""
    for rows in (families(6, 1, 120, 10), copies(7, 3, 40, 10)):
        sets = {i: s for i, s in ((i, shingles(t, 2)) for i, t in rows)}
        distinct = {frozenset(s): i for i, s in reversed(list(sets.items()))}
        number = {}
        data = [(i, [number.setdefault(x, len(number)) for x in s]) for s, i in distinct.items()]
        frame = spark.createDataFrame(data, "rep long, shingles array<long>")
        links = minhash.crowd_links(frame.selectExpr("1L AS bucket", "rep"), frame, 80)
        got = [tuple(r) for t in links for r in t.collect()]
        for a, b in got:
            assert 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
        ids = sorted(distinct.values())
        want = [(i, j) for i in ids for j in ids if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
        assert roots(ids, got) == roots(ids, want) and want


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def brute_lines(rows, edits=linededup.EDITS, words_per_edit=linededup.WORDS_PER_EDIT, least_words=linededup.LEAST_WORDS):
    """(id, place) of the lines that go, for rows with distinct ids or equal texts."""
    first, places = {}, []
    for i, t in sorted(set(rows), key=lambda r: -1 if r[0] is None else r[0]):
        for p, line in enumerate((t or "").split("\n")):
            words = tuple(re.findall(r"[^\x20\x09-\x0D]+", line))
            if words:
                at = (-1 if i is None else i, p)
                known = (words, i if len(words) < least_words else "")
                places.append((at, known))
                first[known] = min(first.get(known, at), at)
    most = {x: first[x] for x in first if len(x[0]) >= edits * words_per_edit}
    near = {x for x in most for y in most if x != y and first[y] < first[x] and abs(len(x[0]) - len(y[0])) <= edits and distance(x[0], y[0]) <= edits}
    return {at: "near" if known in near else "exact" for at, known in places if known in near or first[known] != at}


@pytest.mark.parametrize("k", [1, 2, 4])
def test_banded_bit_parallel_distance(spark, k):
    rng = random.Random(k)
    pairs = []
    for _ in range(400):
        a = [rng.choice("abc") for _ in range(rng.randint(1, 14))]
        b = list(a)
        for _ in range(rng.randint(0, k + 2)):
            at = rng.randint(0, len(b))
            b = rng.choice([b[:at] + b[at + 1 :], b[:at] + [rng.choice("abc")] + b[at:], b[:at] + [rng.choice("abc")] + b[at + 1 :]])
        if b:
            pairs.append(tuple(sorted((a, b), key=len)))
    df = spark.createDataFrame(pairs, "x array<string>, y array<string>")
    got = df.select("x", "y", linededup.within_edits(F.col("x"), F.col("y"), k).alias("near")).collect()
    assert all(r.near == (distance(r.x, r.y) <= k) for r in got) and {r.near for r in got} == {True, False}


@pytest.mark.parametrize(("edits", "words_per_edit"), [(1, 8), (2, 5)])
def test_line_dedup_matches_brute_force(spark, edits, words_per_edit):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 5)))
    base = [[word() for _ in range(rng.randint(6, 16))] for _ in range(12)]

    def vary(words):
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            k = rng.randrange(len(words))
            words = rng.choice([words[:k] + words[k + 1 :], [*words[:k], "q", *words[k:]], [*words[:k], word(), *words[k + 1 :]]])
        return rng.choice([" ", "  ", "\t"]).join(words)

    rows = [(i, "\n".join(vary(rng.choice(base)) for _ in range(rng.randint(1, 5)))) for i in range(60)]
    stem = "page number %s of this very long and numbered report"
    rows += [(100 + i, stem % (f"{i:02d}" if i < 60 else f"1 {i:02d}")) for i in range(90)]
    rows += [(500, None), (501, ""), (502, "short line\nother\nshort line"), (503, "short line"), (None, vary(base[0]) + "\nunique line of the null document"), (504, "  " + " ".join(base[1]) + "\t\r\n\n\nx"), rows[3]]
    rows += [(600, "w " * 20000 + "\n" + "w " * 20000)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("pos", F.lit("clash")).withColumn("line", F.lit("clash")).withColumn("words", F.lit("clash"))
    keyed = linededup.keyed(docs.filter("doc_id is null or doc_id <> 600"), "text", "doc_id")
    some = [r for r in rows if r[0] != 600]
    got = {(-1 if r.doc_id is None else r.doc_id, r.pos): r.kind for r in linededup.dropped_lines(keyed, edits=edits, words_per_edit=words_per_edit).collect()}
    want = brute_lines(some, edits, words_per_edit)
    assert got == want and {"near", "exact"} == set(want.values())
    if edits > 1:
        return
    want |= {(600, 1): "exact"}
    texts = {(r.doc_id, i): r for i, r in enumerate(linededup.dedup_lines(docs).orderBy("doc_id").collect())}
    assert len(texts) == len(rows)
    for (i, _), r in texts.items():
        t = dict(rows)[i]
        kept = None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (-1 if i is None else i, p) not in want)
        assert r.text == kept and r.pos == "clash"
    assert linededup.dedup_lines(docs.limit(0)).count() == 0


def test_deltas_are_unfolded_once(spark, monkeypatch):
    """The number of differences that are held against each other is that of the members who may have links, and is made once."""
    centre = list(range(100))
    sets = [(i, [x for x in centre if x != i]) for i in range(1, 60)] + [(100 + i, [*centre[20:], *range(1000 + 100 * i, 1030 + 100 * i)]) for i in range(1, 40)]
    frame = spark.createDataFrame(sets, "rep long, shingles array<long>")
    made, plans, written = {}, [], minhash.written

    def counted(df, kind="table"):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        made[kind] = (out := written(df, kind)).count()
        return out

    monkeypatch.setattr(minhash, "written", counted)
    members = minhash.centred(frame.selectExpr("1L AS bucket", "rep"), frame, 80)
    assert members.filter("w + low_w > 0").count() == 39
    assert minhash.delta_links(members, 80, False).count() == 0
    assert sum(p.count("Generate explode(delta") for p in plans) == 1 and made["differences"] == 0


def test_groups_without_a_centre_are_unfolded_once_and_in_part(spark, monkeypatch):
    """Of a group of many families, only the beginnings of the differences are unfolded, in one round, whatever another group does."""
    rng = random.Random(9)
    sets = {100 * f + k: {*range(1000 * f, 1000 * f + 100)} - {1000 * f + x for x in rng.sample(range(100), 8)} for f in range(12) for k in range(6)}
    near = {5000 + k: {*range(90_000, 90_100)} - {90_000 + x for x in rng.sample(range(100), k % 15)} for k in range(60)}
    both = sets | near
    frame = spark.createDataFrame([(i, sorted(s)) for i, s in both.items()], "rep long, shingles array<long>")
    made, written = {}, minhash.written

    def counted(df, kind="table"):
        out = written(df, kind)
        made.setdefault(kind, []).append(out.count())
        return out

    monkeypatch.setattr(minhash, "written", counted)
    links = minhash.crowd_links(frame.selectExpr("if(rep < 5000, 1L, 2L) AS bucket", "rep"), frame, 80)
    got = {tuple(r) for t in links for r in t.collect()}
    want = [(i, j) for i in both for j in both if i < j and 100 * len(both[i] & both[j]) >= 80 * len(both[i] | both[j])]
    assert got <= set(want) and roots(both, got) == roots(both, want)
    assert sum(made["differences"]) < 0.5 * sum(len(s) for s in sets.values())
