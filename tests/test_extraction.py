"""Extraction from reports and captions: spans against Python's matches, rules on small reports, blocks of captions against a plain walk."""

import random
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from partledger.functions import spans as X
from partledger.operators import captions as C
from partledger.operators import extraction as E
from partledger.operators import lexicons as L
from partledger.operators.blocks import html_blocks


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("ab1é语 ", max_size=12), min_size=1, max_size=6))
def test_spans_match_python(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for pattern in (r"a+(b?)", r"[0-9]|(é语)", r"(b)|a{2}"):
        got = df.select("t", X.all_spans(F.col("t"), pattern, 1).alias("s"), X.first_span(F.col("t"), pattern, 1).alias("f")).collect()
        for r in got:
            want = [(m.start(), m.end(), m.group(0), m.group(1) or "") for m in re.finditer(pattern, r.t)]
            assert [tuple(s) for s in r.s] == want and (tuple(r.f) if r.f else None) == (want[0] if want else None)


def test_clauses_and_context(spark):
    row = spark.createDataFrame([("甲。 乙！丙;丁",)], "t string").select(X.clauses(F.col("t")).alias("c"), X.around(F.col("t"), F.lit(3), F.lit(4), 2).alias("a"), X.around(F.col("t"), F.lit(0), F.lit(1), 3).alias("b")).first()
    assert row.c == ["甲。", "乙！", "丙;", "丁"] and row.a == "。 乙！丙" and row.b == "甲。 乙"


def inventory(spark, html):
    return E.teardown_inventory(html_blocks(spark.createDataFrame([(1, html)], "id long, html string"), "id", "html"), "id").orderBy("pos", "clause", "rule").collect()


def test_side_decision(spark):
    rows = [("为耳机充电的Pogo Pin连接器", "充电盒拆解"), ("充电盒与耳机之间的连接器", "产品拆解"), ("前腔有泡棉", ""), ("泡棉", "充电盒与耳机"), ("座舱支架", "三、其他")]
    got = spark.createDataFrame(rows, "c string, h string").select(E.side_decision(F.col("c"), F.col("h")).alias("s")).collect()
    assert [(r.s.side, r.s.side_status) for r in got] == [("充电盒", "resolved"), ("", "needs_review"), ("耳机", "resolved"), ("", "needs_review"), ("充电盒", "resolved")]
    assert got[0].s.side_reason.startswith(L.SIDE_BY_HEADING) and got[1].s.side_reason == L.SIDE_CONFLICT and got[3].s.side_reason == L.SIDE_UNKNOWN


def test_only_the_teardown_counts_and_parts_once(spark):
    rows = inventory(spark, "<h2>开箱</h2><p>晶振在此。</p><h2>拆解</h2><p>晶振一颗。</p><p>又见晶振。</p><p>晶振X1234；短</p><h2>总结</h2><p>屏蔽罩在此。</p>")
    assert [(r.component, r.model, r.fact_text) for r in rows] == [("晶振", "", "晶振一颗。"), ("晶振", "X1234", "晶振X1234；")]
    assert [r.component for r in inventory(spark, "<p>屏蔽罩在此。</p><p>拆解总结：</p><p>晶振在此。</p>")] == ["屏蔽罩"]
    assert inventory(spark, "") == [] and inventory(spark, None) == []


def test_images_within_four_blocks(spark):
    html = "<h2>拆解</h2><img src=a.png alt=A><p>一二三四五</p><p>一二三四五</p><p>一二三四五</p><p>晶振在这里</p><p>屏蔽罩在这里</p><img src=b.png><p>热敏电阻在此</p><img alt=none><p>一二三四五</p><p>一二三四五</p><p>一二三四五</p><p>功率电感在此</p>"
    assert {r.component: (r.image, r.alt) for r in inventory(spark, html)} == {"晶振": ("b.png", ""), "屏蔽罩": ("b.png", ""), "热敏电阻": ("b.png", ""), "功率电感": (None, None)}


def test_models_of_parts(spark):
    rows = [("型号： AB 12，电池", "电池"), ("丝印 Q 7的MOS管", "MOS管"), ("锂电池CR1632", "电池"), ("Type-C接口500mAh与CW2015芯片", "IC"), ("USB-C 3V", "x"), ("TYPE-C与abc12", "x")]
    got = spark.createDataFrame(rows, "c string, k string").select(E.part_model(F.col("c"), F.col("k")).alias("m")).collect()
    assert [r.m for r in got] == ["AB 12", "Q7", "", "CW2015", "", "abc12"]


def test_prose_without_anchors_or_text(spark):
    rows = [(1, None), (2, ""), (3, "内置两颗MEMS麦克风。再有三颗麦克风。"), (4, "充电盒内置10mm单元；充电仓采用100mAh电池，容量100mAh电池"), (5, "芯片为恒玄 BES2500；BES 2500；恒玄BES2500耳机内置恒玄BES2500")]
    got = E.prose_parts(spark.createDataFrame(rows, "id long, t string"), "id", "t").orderBy("id", "place").collect()
    assert [(r.id, r.component, r.model, r.qty, r.side) for r in got] == [
        (3, "麦克风", "MEMS麦克风", "2", "耳机"), (4, "喇叭单元", "10mm 动圈单元", "1", "充电盒"), (4, "电池", "100mAh", "1", "充电盒"), (5, "芯片/模组", "恒玄 BES2500", "1", ""),
        (5, "芯片/模组", "BES2500", "1", ""), (5, "芯片/模组", "恒玄BES2500", "1", "耳机"), (5, "芯片/模组", "BES2500", "1", "耳机"),
    ]


def test_rule_tables(spark):
    texts = [(i, t) for i, t in enumerate(["额定容量：58mAh", "额定容量58MAH，sram 30KB SRAM", "nothing", None, "30KBSRAM"])]
    rules = [(label, literal, pattern) for label, literal, pattern in L.PARAMETER_RULES]
    got = E.rule_table_spans(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(rules, "rule string, literal string, pattern string")).collect()
    want = {(i, label, m.start(), m.end(), m.group(1).strip()) for i, t in texts for label, _, p in rules if t and (m := re.search(p, t, re.I))}
    assert {(r.id, r.rule, r.start, r.end, r.value) for r in got} == want and len(want) == 4
    bad = spark.createDataFrame([("x", "", "x")], "rule string, literal string, pattern string")
    try:
        E.rule_table_spans(spark.createDataFrame(texts, "id long, text string"), bad)
    except ValueError as e:
        assert "literal" in str(e)
    else:
        raise AssertionError("a rule without a literal was taken")


def walked(rows):
    """The context of each caption of one video, by walking from caption to caption."""
    def family(t):
        b = re.sub(L.CAPTION_MARKS, "", t).lower()
        return next((f for f, p in L.CAPTION_FAMILIES if re.search(p, b, re.I)), "") or None

    def models(t):
        found = [m.group(0).strip("-_") for m in re.finditer(L.CAPTION_MODEL, t)]
        return [m for m in found if "cortex" not in m.lower() and not re.match(L.PARAMETER_SHAPED, m)]

    rows = sorted(rows)
    fam, text = [family(r[3]) for r in rows], [r[3].strip(" ") for r in rows]
    ident = [bool(models(r[3]) and re.search(L.CAPTION_IDENTITY, r[3].strip(" "))) for r in rows]
    goes = [bool(re.search(L.CAPTION_CONTINUES, r[3].strip(" "))) for r in rows]
    near = lambda i: rows[i + 1][0] - rows[i][1] <= C.GAP
    out = {}
    for p in range(len(rows)):
        of, anchor = fam[p], p
        if not of and ident[p] and p + 1 < len(rows) and near(p):
            of = fam[p + 1]
        if not of and (goes[p] or ident[p]):
            for i in range(p - 1, max(-1, p - 6), -1):
                if not near(i):
                    break
                if fam[i]:
                    of, anchor = fam[i], i
                    break
                if not (goes[i] or ident[i]):
                    break
        if not of:
            out[rows[p][2]] = (None, text[p])
            continue
        left, right = anchor, p
        while not models(rows[anchor][3]) and left > 0 and anchor - left < 5 and near(left - 1) and (fam[left - 1] == of or (not fam[left - 1] and ident[left - 1])):
            left -= 1
        while right + 1 < len(rows) and right - anchor < 6 and near(right):
            f = right + 1
            if fam[f] and fam[f] != of:
                break
            if ident[f] and f + 1 < len(rows) and near(f) and fam[f + 1] and fam[f + 1] != of:
                break
            if not (fam[f] == of or goes[f] or ident[f]):
                break
            right += 1
        out[rows[p][2]] = (of, "；".join(dict.fromkeys(t for t in text[left : right + 1] if t)))
    return out


def test_context_blocks_match_a_walk(spark):
    rnd = random.Random(9)
    said = ["这是一颗电源管理芯片", "型号 IP5306", "型号 TS100", "额定电压3V", "用于供电", "扬声器", "容量5mAh", "内置电池", "丝印 HL100", "外观", "麦克风放大器", "32位MCU CH579", "这是BT8901", "", "蓝牙音频SoC BT8901"]
    rows, i = [], 0
    for video in range(12):
        at = 0.0
        for _ in range(rnd.randint(1, 60)):
            at += rnd.choice([1.0, 2.0, 5.0, 6.0, 6.5])
            rows.append((video, at, at + 1.0, i, rnd.choice(said)))
            i += 1
    df = spark.createDataFrame(rows, "video long, start double, end double, id long, text string")
    got = {r.id: (r.family, r.context) for r in C.context_blocks(df, "video", "start", "end", "id", "text").collect()}
    want = {}
    for video in range(12):
        want |= walked([r[1:] for r in rows if r[0] == video])
    assert got == want and sum("；" in c for _, c in want.values()) > 50


def test_caption_query_matches_a_walk(spark):
    from partledger.plans import registry
    from partledger.plans.captions import captions
    from partledger.sources.tables import table

    sf = "/root/testdata/sf0.001"
    videos = {}
    for r in captions(table(spark, sf, "lineitem")).distinct().collect():
        videos.setdefault(r.video, []).append((r.start, r.end, r.id, r.text))
    got = {(r.video, r.start, r.id): (r.family, r.context) for r in registry.queries()["caption_context"](spark, sf).collect()}
    for video, rows in videos.items():
        if len({r[2] for r in rows}) == len(rows):  # the walk's result is by id
            start = {r[2]: r[0] for r in rows}
            assert {(video, start[i], i): c for i, c in walked(rows).items()} == {k: v for k, v in got.items() if k[0] == video}


def test_summary_start(spark):
    rows = [("a", t, t, x, 100.0) for t, x in [(10.0, "总结一下"), (60.0, "内部主要配置方面"), (70.0, "以上就是全部拆解"), (80.0, "最后来看")]]
    rows += [("b", t, t, x, 100.0) for t, x in [(60.0, "以上就是全部拆解"), (70.0, "最后来看")]] + [("c", 56.0, 56.0, "下面回顾总结", 100.0), ("d", 1.0, 1.0, "别的", 100.0)]
    got = C.summary_start(spark.createDataFrame(rows, "v string, start double, id double, text string, duration double"), "v", "start", "id", "text", "duration").collect()
    assert {r.v: (r.detected, r.summary_start, r.strong, r.weak) for r in got} == {"a": (True, 60.0, 0, 3), "b": (False, None, 0, 2), "c": (True, 56.0, 1, 0), "d": (False, None, 0, 0)}


def test_short_rows_are_dealt_out_before_they_are_read(spark, monkeypatch):
    from partledger.sources import tables

    monkeypatch.setattr(tables, "DEALT_ROWS", 16)
    sf = "/root/testdata/sf0.001"
    part, whole = tables.dealt(spark, sf, "part"), tables.table(spark, sf, "part")
    files = len(part.inputFiles())
    assert files > 6 and sorted(part.collect()) == sorted(whole.collect())
    assert tables.dealt(spark, sf, "supplier").inputFiles() == tables.table(spark, sf, "supplier").inputFiles()


def test_blocks_are_made_of_a_few_pages_at_a_time():
    import pyarrow as pa

    from partledger.operators.blocks import block_batches

    pages = [None if i == 5 else "" if i == 6 else f"<h1>t{i}</h1><p>a<br>b</p><img src='s{i}'>" for i in range(1000)]
    given = pa.RecordBatch.from_pydict({"page_id": pa.array(range(1000), pa.int64()), "html": pages})
    got = list(block_batches(iter([given]), "page_id", "html"))
    assert max(len(set(b.column("page_id").to_pylist())) for b in got) <= 128
    rows = [tuple(r.values()) for b in got for r in b.to_pylist()]
    assert rows == [r for i in range(1000) if i not in (5, 6) for r in [(i, 0, "h1", 1, "body", f"t{i}", ""), (i, 1, "p", 0, "body", "a b", ""), (i, 2, "img", 0, "body", "", f"s{i}")]]


def test_caption_marks_are_taken_off_once(spark):
    """A caption's text without marks is made once, not for each family that it is held against."""
    from partledger.operators import captions

    rows = spark.createDataFrame([(1, 0.0, 1.0, 1, "电池 <b>")], "video long, start double, end double, id long, text string")
    plan = captions.context_blocks(rows, "video", "start", "end", "id", "text")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 1
