"""The pipeline on a small corpus: what each stage takes away and what it leaves, against brute force."""

import random

import pytest
from pyspark.sql import functions as F
from test_duplicates import brute_components, brute_lines

import corpus_pipeline
from partledger.llm.common import table, written

BAD = ["zgrum", "vexpat", "qolbun"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(3, 7)))
    line = lambda n=14: " ".join(word() for _ in range(n))
    items = [(i, line(15)) for i in range(5)]
    boilerplate = line(55)
    rows, labels = [], []
    for i in range(400):
        text = "\n".join(line() for _ in range(4))
        if i % 4 == 0:
            w = text.split(" ")
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(BAD))
            text = " ".join(w)
        elif i % 10 == 1:
            text += "\n" + boilerplate
        elif i % 20 == 3:
            text += " " + items[i % 5][1].upper()
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, 1, int(i % 4 == 0)))
    base = " ".join(word() for _ in range(120))
    for k in range(6):
        w = base.split(" ")
        w[17 * k + 3] = word()
        rows.append((1000 + k, " ".join(w), "en", "s0", len(base)))
    rows += [(2000, None, "en", None, None), (2001, "", "en", "s1", 0), (None, line(30), None, "s2", 1)]
    folder = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"file://{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"file://{folder}/benchmark.parquet")
    return f"file://{folder}"


def test_stages(spark, corpus):
    docs = table(spark, corpus, "documents")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        out = written(stage(spark, docs, corpus), "test-stage")
        after = out.collect()
        ids = {r.doc_id for r in after}
        gone = {i for i, _ in before} - ids
        if name == "toxicity":
            assert {i for i in gone if i is None or i % 4 or i >= 400} == set() and len(gone) >= 95
        if name == "line dedup":
            drop = brute_lines(before)
            for r in after:
                if r.text is not None:
                    assert r.text == "\n".join(x for p, x in enumerate(dict(before)[r.doc_id].split("\n")) if (-1 if r.doc_id is None else r.doc_id, p) not in drop)
            assert len(drop) >= 20 and not gone
        if name == "near-duplicates":
            roots = brute_components(before, 5)
            assert gone == {i for i, r in roots.items() if i != r} and len(gone) == 5
        if name == "decontamination":
            assert gone and all(i % 20 == 3 for i in gone)
        if name == "mixing":
            total = sum(len((t or "").split()) for _, t in before)
            assert abs(sum(r.taken for r in after) - total) <= 3 and all(0 < r.taken <= 3 * r.size for r in after)
        elif name != "mixing":
            assert out.columns == docs.columns
        kept[name] = ids
        docs = out


def test_run_gives_the_last_stage(spark, corpus):
    assert sorted(map(str, corpus_pipeline.run(spark, corpus).collect())) == sorted(map(str, corpus_pipeline.run(spark, corpus).collect()))


def test_stages_on_odd_tables(spark, corpus):
    """Repeated rows, extra columns with clashing names, and an empty table."""
    docs = table(spark, corpus, "documents").filter("doc_id < 40 or doc_id is null")
    clash = docs.unionByName(docs.filter("doc_id = 7")).withColumns({c: F.lit("clash") for c in ("score", "kept", "n_exact", "rep", "n_hit", "words", "_terms")})
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, clash, corpus)
        if name != "mixing":
            assert out.columns == corpus_pipeline.COLUMNS
        ids = [r.doc_id for r in out.select("doc_id").collect()]
        assert len(ids) <= docs.count() + 1 and ids.count(7) in (0, 1, 2)
        assert stage(spark, docs.limit(0), corpus).count() == 0
