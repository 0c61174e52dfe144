"""Reports, nested records, repairs and merged captions on odd rows and against brute force."""

import json
import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from partledger.functions.text import mixed_tokens
from partledger.operators import captions as C
from partledger.operators import nested as N
from partledger.operators import records as R
from partledger.operators import repair
from partledger.operators import reports as P
from partledger.operators import similarity as S
from partledger.operators.blocks import html_media
from partledger.sources import readers, writers

values = st.recursive(st.one_of(st.none(), st.booleans(), st.integers(-5, 5), st.text("ab{}\"\\[]é", max_size=5)), lambda x: st.one_of(st.lists(x, max_size=3), st.dictionaries(st.sampled_from(["a", "b c", "url", "é"]), x, max_size=3)), max_leaves=12)


def strings(v, path=""):
    if isinstance(v, dict):
        for k, x in v.items():
            if k != "url":
                yield from strings(x, f"{path}.{k}" if path else k)
    elif isinstance(v, list):
        for i, x in enumerate(v):
            yield from strings(x, f"{path}[{i}]")
    elif isinstance(v, str):
        yield path, v


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(values, min_size=5, max_size=25))
def test_display_strings_match_a_walk(spark, records):
    rows = [(i, json.dumps(v, ensure_ascii=False)) for i, v in enumerate(records)] + [(100, None), (101, "{bad"), (102, '"s" tail'), (103, "")]
    got = {(r.id, r.path, r.text) for r in N.display_strings(spark.createDataFrame(rows, "id long, j string"), "id", "j").collect()}
    assert got == {(i, p, t) for i, v in enumerate(records) for p, t in strings(v)}


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.dictionaries(st.sampled_from(["a", "}{", "\\\""]), values, max_size=3), min_size=5, max_size=20), st.sampled_from(["", "so: ", "```json\n", "see [1] "]), st.sampled_from(["", "\n```", " {\"x\": 1}", " }"]))
def test_first_object_round_trip(spark, objects, before, after):
    rows = [(i, before + json.dumps(o) + after) for i, o in enumerate(objects)]
    got = {r.id: r.o for r in spark.createDataFrame(rows, "id long, t string").select("id", N.first_object(F.col("t")).alias("o")).collect()}
    assert {i: json.loads(o) for i, o in got.items()} == dict(enumerate(objects))


def test_broken_text_is_read_again(spark):
    good = ["漫步者 é ñ", "“quoted” – 100 €", "ascii", "Ã alone", "", "naïve ✓ 日本", "\u0085x"]
    broken = [g.encode().decode("latin-1") for g in good[:2]] + [good[5].encode().decode("cp1252", "replace")] + ["拆解：" + "é".encode().decode("latin-1"), "漫步è\u0080", None]
    again = lambda rows: [r[0] for r in spark.createDataFrame([(t,) for t in rows], "t string").select(repair.repaired_text(F.col("t"))).collect()]
    assert again(good)[:6] == good[:6]
    fixed = again(broken)
    assert fixed[0] == good[0] and fixed[1] == good[1] and fixed[3] == "拆解：é" and fixed[4] == "漫步者" and fixed[5] is None
    flags = spark.createDataFrame([("a\u0081",), ("a",), (None,)], "t string").select(repair.has_controls(F.col("t"))).collect()
    assert [r[0] for r in flags] == [True, False, False]


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("éñ€语 a“", max_size=8), min_size=1, max_size=20))
def test_repair_undoes_windows_reading(spark, texts):
    def shown(t):
        return "".join(bytes([b]).decode("cp1252") if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in t.encode())

    rows = [(t, shown(t)) for t in texts]
    got = spark.createDataFrame(rows, "t string, s string").select("t", repair.decoded_again(F.col("s")).alias("d")).collect()
    assert all(r.t == r.d for r in got)


def merged(rows):
    out = []
    for v, s, e, t, n in sorted(rows):
        if not S.spoken(t or ""):
            continue
        if out and out[-1][0] == v and s <= out[-1][2] + 0.25 and S.same_text(out[-1][3], t):
            last = out[-1]
            out[-1] = (v, last[1], max(last[2], e), t if len(S.spoken(t)) > len(S.spoken(last[3])) else last[3], last[4] + n)
        else:
            out.append((v, s, e, t, n))
    return out


def test_merged_captions_match_a_fold(spark):
    rnd = random.Random(11)
    said = ["这是主板", "这是主板。", "这是主板特写", "别的话", "", "再见了", "这是一块主板特写镜头"]
    rows = [(v, round(rnd.random() * 40, 2), 0.0, rnd.choice(said), rnd.randint(1, 3)) for v in range(4) for _ in range(60)]
    rows = sorted({(v, s, round(s + rnd.choice([0.1, 0.5, 3.0]), 2), t, n) for v, s, _, t, n in rows}) + [(9, 1.0, 2.0, None, 1)]
    got = C.merged_captions(spark.createDataFrame(rows, "v long, start double, end double, text string, samples long").repartition(3), "v", "start", "end", "text", "samples").collect()
    assert sorted(map(tuple, got)) == sorted(merged([r for r in rows if r[3]])) and len(got) < 170


def test_merge_query_matches_a_fold(spark):
    from partledger.plans import registry

    sf = "/root/testdata/sf0.001"
    said = ("这是耳机的主板", "这是耳机的主板特写", "另一段话", "这是耳机的主板。", "", "这是耳机主板")
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_suppkey", "l_orderkey", "l_partkey").collect()
    rows = {(r.l_suppkey, float(r.l_orderkey), r.l_orderkey + (0.5 if r.l_partkey % 3 == 0 else 0.9), said[r.l_partkey % len(said)], 1) for r in lines}
    got = registry.queries()["caption_merge"](spark, sf).select("video", "start", "end", "text", "samples").collect()
    assert sorted(map(tuple, got)) == sorted(merged(rows)) and len(got) < len(rows)


def test_sameness_in_tasks_and_in_expressions_agree(spark):
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("ab，c d") for _ in range(rnd.randint(0, 9)))
    rows = [(word(), word()) for _ in range(200)]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", S.text_is_same(F.col("a"), F.col("b")).alias("same")).collect()
    assert all(r.same == S.same_text(r.a, r.b) for r in got) and any(r.same for r in got)


def test_json_cues(spark):
    files = [("a", '{"body": [{"from": 1, "to": 2.5, "content": "<i>x</i> &amp; y"}, {"from": 3, "to": 4, "content": " "}]}'), ("b", '[{"start": 1, "end": 2, "text": "t"}]'), ("c", "no json"), ("d", '{"other": 1}'), ("e", None)]
    got = readers.json_cues(spark.createDataFrame(files, "k string, c string"), "k", "c").collect()
    assert sorted(map(tuple, got)) == [("a", 0, 1.0, 2.5, "x & y"), ("b", 0, 1.0, 2.0, "t")]


def test_media_of_pages(spark):
    html = "<img src='//a/b.png' alt=\"x y\"><IMG data-src=no SRC=c.png><iframe src=\"https://p/v\"></iframe><!-- <img src=d.png> --><img alt=only><iframe></iframe>"
    got = html_media(spark.createDataFrame([(1, html), (2, None)], "id long, html string"), "id", "html").collect()
    assert sorted(map(tuple, got)) == [(1, "frame", 0, "https://p/v", ""), (1, "image", 0, "https://a/b.png", "x y"), (1, "image", 1, "c.png", "")]


def test_reports_without_text(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "螺丝")], "id long, t string")
    assert P.sentence_filters(docs, "id", "t").count() == P.image_specs(docs, "id", "t").count() == P.image_parts(docs, "id", "t").count() == 0
    assert P.tech_specs(docs, "id", "t").count() == 0
    assert [r[0] for r in docs.select(P.form_labels(F.col("t"))).collect()] == [[], [], []]
    assert [r[0] for r in docs.select(mixed_tokens(F.col("t"))).collect()] == [[], [], ["螺丝"]]


def test_sentences_of_structure_begin_alike_once(spark):
    long = "内部结构" + "很长" * 40
    docs = spark.createDataFrame([(1, f"{long}甲。{long}乙。包装盒内部结构非常非常固定。内部短句子")], "id long, t string")
    got = P.sentence_filters(docs, "id", "t").collect()
    assert [(r.filter, r.place, r.sentence) for r in got] == [("structure", 1, f"{long}甲")]


def test_collated_places_cut_keys_into_ranges(spark):
    rows = [(i, "k" if i % 3 else None, w) for i, w in enumerate(["重庆", "北京", "安徽", None, "b", "阿里", "a", "安徽"] * 4)]
    got = R.numbered(spark.createDataFrame(rows, "id long, k string, w string"), ["k"], [F.collate("w", "zh"), F.col("id")], "place").collect()
    by = sorted((r for r in got if r.k == "k"), key=lambda r: r.place)
    assert [r.place for r in by] == list(range(len(by)))
    names = list(dict.fromkeys(r.w for r in by))
    assert names == [None, "阿里", "安徽", "北京", "重庆", "a", "b"]


def test_marked_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, None)], "id long, tags array<string>").coalesce(1)
    writers.write_marked_csv(df, f"file://{tmp_path}/x", ["tags"])
    (file,) = (p for p in (tmp_path / "x").iterdir() if p.name.startswith("part-"))
    assert file.read_bytes().decode() == '﻿"id","tags"\n"1","a;b"\n"2",""\n'
