"""Operator 6: line deduplication by a segment-partition edit join, in DataFrame operations only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partledger.llm.common import small, table, text_key, written

#: Word edits that near lines may be apart. Lines are cut into this many segments and one more, so one segment is equal.
EDITS = 1
#: Words that a line needs for each edit to be compared with near ones; shorter lines have exact copies only.
WORDS_PER_EDIT = 8
#: Lines of fewer words ("Contents", "* * *") are copies only of lines in their own document.
LEAST_WORDS = 3
#: Lines in a bucket up to which all pairs are verified; larger buckets are split further, losing none.
PAIRS = 16
#: Parts into which the open region of a large bucket is split.
PARTS = 16

DOC = ["doc_id", "d0", "d1"]
LINE = ["l0", "l1"]
SPACES = r"[\x20\x09-\x0D]+"


def region_key(length: Column, a: Column, b: Column, words: Column) -> Column:
    """A hash of the words outside the region [a, b) of a line of the given length; of a longer line, the same ends."""
    after = length - b
    return F.xxhash64(length, a, b, F.slice(words, F.lit(1), a), F.slice(words, F.size(words) - after + 1, after))


def keyed(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(doc_id, d0, d1, text): an id and a 128-bit hash of the text stand for a document."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return rows.select("doc_id", *(h.alias(f"d{i}") for i, h in enumerate(text_key(F.col("text")))), "text")


def lines_of(docs: DataFrame, least_words: int) -> DataFrame:
    """(doc_id, d0, d1, pos, words, l0, l1, n) from keyed documents: lines with a word, known by their words.

    A line of fewer than least_words words is known by its words and its document.
    """
    rows = docs.select(*DOC, F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    rows = rows.withColumn("line", F.btrim("line", F.lit(" \t\r\x0b\x0c"))).filter("line <> ''")
    # Most lines have single spaces already; splitting by one character needs no regex.
    odd = reduce(lambda a, b: a | b, [F.contains("line", F.lit(c)) for c in ("  ", "\t", "\r", "\x0b", "\x0c")])
    rows = rows.withColumn("line", F.when(odd, F.regexp_replace("line", SPACES, " ")).otherwise(F.col("line")))
    rows = rows.withColumn("words", F.split("line", " ", -1)).withColumn("n", F.size("words"))
    name = F.when(F.col("n") < least_words, F.concat_ws("\n", "line", F.concat_ws(" ", *DOC))).otherwise(F.col("line"))
    return rows.select(*DOC, "pos", "words", *(h.alias(f"l{i}") for i, h in enumerate(text_key(name))), "n")


def segment(length: Column, k: int, i: int) -> tuple[Column, Column]:
    """Where segment i of k + 1 of a line of the given length starts (from 0) and ends."""
    at = lambda j: F.floor(length * j / (k + 1)).cast("int")
    return at(i), at(i + 1)


def segment_keys(k: int, least: int) -> Column:
    """The keys of a line as array of (slot, key): first the k + 1 segments of its own length's index, then its probes.

    Lines of n words probe the indexes of n, n - 1, ..., n - k words. A segment of the shorter line is looked for only where
    the edits before it and after it allow: at most i before segment i, at most k - i after it.
    """
    n, words, out = F.col("n"), F.col("words"), []
    key = lambda length, i, start, size: F.xxhash64(length, F.lit(i), F.slice(words, start + 1, size))
    for shorter in range(k + 1):
        length = n - shorter
        for i in range(k + 1):
            a, b = segment(length, k, i)
            for shift in range(max(-i, shorter - (k - i)), min(i, shorter + k - i) + 1):
                slot = i if shorter == 0 and shift == 0 else (k + 1) * (1 + len(out))
                fits = (length >= least) & (a + shift >= 0) & (b + shift <= n)
                out.append(F.when(fits, F.struct(F.lit(slot).alias("slot"), F.lit(shorter).alias("shorter"), F.lit(i).alias("i"), key(length, i, a + shift, b - a).alias("key"))))
    return F.array_compact(F.array(*out))


def within_edits(text: Column, pattern: Column, k: int) -> Column:
    """Whether two word lists, the pattern no shorter, are within k edits: a banded bit-parallel edit distance.

    Bit r of a number stands for the pattern's word j - k + r while word j of the text is read. vp and vn hold where the
    distance rises and falls down the band's column; the distance itself is followed along the diagonal that ends at both ends.
    """
    band, m, n = 2 * k + 1, F.size(pattern), F.size(text)
    full = (1 << band) - 1
    word = lambda xs, i: F.get(xs, i)

    def match(j: Column) -> Column:
        bits = [F.when(F.coalesce(word(pattern, j - k + r) == word(text, j), F.lit(False)), F.lit(1 << r).cast("long")).otherwise(F.lit(0).cast("long")) for r in range(band)]
        out = bits[0]
        for bit in bits[1:]:
            out = out.bitwiseOR(bit)
        return out

    def step(acc: Column, pm: Column) -> Column:
        vp, vn = acc["vp"], acc["vn"]
        zero = ((pm.bitwiseAND(vp) + vp).bitwiseXOR(vp)).bitwiseOR(pm).bitwiseOR(vn).bitwiseAND(F.lit(full).cast("long"))

        def after(d0: Column) -> Column:
            hp = vn.bitwiseOR(F.bitwise_not(d0.bitwiseOR(vp))).bitwiseAND(F.lit(full).cast("long"))
            down = F.shiftright(d0, 1)
            same = d0.bitwiseAND(acc["bit"]) != 0
            return F.struct(
                d0.bitwiseAND(vp).bitwiseOR(F.bitwise_not(down.bitwiseOR(hp))).bitwiseAND(F.lit(full).cast("long")).alias("vp"),
                down.bitwiseAND(hp).alias("vn"),
                (acc["distance"] + F.when(same, 0).otherwise(1)).alias("distance"),
                acc["bit"].alias("bit"),
            )

        return F.element_at(F.transform(F.array(zero), after), 1)

    bit = F.element_at(F.array(*(F.lit(1 << (k + d)).cast("long") for d in range(k + 1))), F.least(m - n, F.lit(k)) + 1)
    start = F.struct(F.lit(((1 << (k + 1)) - 1) << k).cast("long").alias("vp"), F.lit(0).cast("long").alias("vn"), (m - n).alias("distance"), bit.alias("bit"))
    masks = F.transform(F.sequence(F.lit(0), n - 1), match)
    return F.when(n == 0, m <= k).when(m - n <= k, F.aggregate(masks, start, step, lambda acc: acc["distance"]) <= k).otherwise(F.lit(False))


def alike(x: Column, y: Column, k: int) -> Column:
    """What lists within k edits have to meet: all but k words of each stand in the other."""
    return (F.size(F.array_except(x, y)) <= k) & (F.size(F.array_except(y, x)) <= k)


def near_lines(lines: DataFrame, primary: DataFrame, k: int) -> DataFrame:
    """(l0, l1, keeper): lines with an earlier line within k edits, and where the earliest such line first stands.

    lines has the words (as lines_of); primary has each line once, with keys instead of words.
    """
    entries = primary.select(*LINE, "n", F.explode("keys").alias("e")).select(*LINE, "n", "e.slot", "e.shorter", "e.i", "e.key")
    # A line has a key at most once in a slot, and its own index key besides a probe with the same words only.
    crowded = entries.groupBy("key").agg(F.count("*").alias("n"), F.max(F.col("slot") <= k).alias("indexed")).filter("n > 1 and indexed").select("key")
    members = written(entries.join(small(written(crowded, "crowded")), "key", "left_semi"), "members")
    ids = members.select(*LINE).distinct()
    held = written(lines.join(small(ids), LINE, "left_semi").groupBy(*LINE).agg(F.min(F.struct(*DOC, "pos")).alias("at"), F.min("words").alias("words")), "lines")
    length = F.col("n") - F.col("shorter")
    a, b = segment(length, 1, 1)  # for k = 1: what lies outside the equal segment is the open region
    first = F.col("i") == 0
    level = members.join(held, LINE).select("key", length.alias("length"), F.when(first, a).otherwise(0).alias("a"), F.when(first, b).otherwise(a).alias("b"), "n", (F.col("slot") <= k).alias("indexed"), "at", "words", *LINE)
    goes = []

    def later(pairs: DataFrame) -> DataFrame:
        """Of each pair (x and y columns) the line that stands later, and where the earlier one stands."""
        y_later = F.col("x_at") < F.col("y_at")
        pick = lambda c: F.when(y_later, F.col(f"y_{c}")).otherwise(F.col(f"x_{c}")).alias(c)
        return pairs.select(pick("l0"), pick("l1"), F.when(y_later, F.col("x_at")).otherwise(F.col("y_at")).alias("keeper"))

    def sides(frame: DataFrame, side: str, *more: str) -> DataFrame:
        return frame.select("key", *(F.col(c).alias(f"{side}_{c}") for c in (*LINE, "at", *more)))

    while True:
        level = written(level, "level")
        sizes = level.groupBy("key").agg(F.count("*").alias("size"), F.max("indexed").alias("any")).filter("size > 1 and any")
        sized = level.join(sizes.drop("any"), "key")
        # With one edit all outside the open region is equal, so the region alone is compared.
        few = sized.filter(F.col("size") <= PAIRS).withColumn("words", F.slice("words", F.col("a") + 1, F.col("b") - F.col("a") + F.col("n") - F.col("length"))) if k == 1 else sized
        x, y = sides(few.filter("indexed"), "x", "words", "n"), sides(few, "y", "words", "n", "indexed")
        pairs = x.join(y, "key").filter("(x_l0 <> y_l0 or x_l1 <> y_l1) and (y_n > x_n or not y_indexed or x_l0 < y_l0 or (x_l0 = y_l0 and x_l1 < y_l1))")
        goes.append(written(later(pairs.filter(alike(F.col("x_words"), F.col("y_words"), k) & within_edits(F.col("x_words"), F.col("y_words"), k))).distinct(), "near"))
        many = sizes.filter(F.col("size") > PAIRS)
        if k > 1 or many.limit(1).count() == 0:
            break
        hot = written(sized.filter(F.col("size") > PAIRS).drop("size"), "hot")
        # A region of one word: the lines of the index differ there alone, so all are near the earliest; a line
        # that is one longer is near the line that has one of its two words there.
        last = hot.filter("b - a <= 1")
        at = lambda i: F.get("words", F.col("a") + i)
        indexed = last.filter("n = length").withColumn("word", at(0))
        earliest = indexed.groupBy("key").agg(F.min(F.struct("at", *LINE)).alias("x")).select("key", *(F.col(f"x.{c}").alias(f"x_{c}") for c in (*LINE, "at")))
        goes.append(written(later(earliest.join(sides(indexed, "y"), "key").filter("x_l0 <> y_l0 or x_l1 <> y_l1")).distinct(), "near"))
        longer = last.filter("n = length + 1").withColumn("word", F.explode(F.array_distinct(F.array(at(0), at(1)))))
        x, y = indexed.select("key", "word", *(F.col(c).alias(f"x_{c}") for c in (*LINE, "at"))), longer.select("key", "word", *(F.col(c).alias(f"y_{c}") for c in (*LINE, "at")))
        goes.append(written(later(x.join(y, ["key", "word"])).distinct(), "near"))
        width = F.col("b") - F.col("a")
        cut = lambda j: F.col("a") + F.floor(width * j / PARTS).cast("int")
        parts = F.filter(F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda j: F.struct(cut(j).alias("a"), cut(j + 1).alias("b"))), lambda p: p["a"] < p["b"])
        finer = hot.filter("b - a > 1").withColumn("part", F.explode(parts)).withColumns({"a": F.col("part.a"), "b": F.col("part.b")}).drop("part")
        level = finer.withColumn("key", region_key(F.col("length"), F.col("a"), F.col("b"), F.col("words")))
    out = goes[0]
    for more in goes[1:]:
        out = out.unionByName(more)
    return out.groupBy(*LINE).agg(F.min("keeper").alias("keeper"))


def dropped_lines(docs: DataFrame, *, edits: int = EDITS, words_per_edit: int = WORDS_PER_EDIT, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, d0, d1, pos, kind, keeper) from keyed documents: the lines that go, exact or near copies of a line elsewhere."""
    lines = lines_of(docs, least_words)
    narrow = written(lines.withColumn("keys", segment_keys(edits, max(edits * words_per_edit, edits + 1))).drop("words"), "narrow")
    at = F.struct(*DOC, "pos")
    repeated = written(narrow.groupBy(*LINE).agg(F.count("*").alias("copies"), F.min(at).alias("first")).filter("copies > 1").drop("copies"), "repeated")
    # Repeated rows of a document give equal places, hence the distinct.
    primary = narrow.filter(F.size("keys") > 0).join(small(repeated), LINE, "left").filter(F.col("first").isNull() | at.eqNullSafe(F.col("first")))
    again = primary.filter(F.col("first").isNotNull()).select(*LINE, "n", "keys").distinct()
    near = near_lines(lines, primary.filter(F.col("first").isNull()).select(*LINE, "n", "keys").unionByName(again), edits)
    verdicts = written(repeated.join(near, LINE, "full"), "verdicts")
    held = narrow.drop("keys", "n").join(small(verdicts), LINE)
    held = held.withColumn("kind", F.when(F.col("keeper").isNotNull(), F.lit("near")).when(~at.eqNullSafe(F.col("first")), F.lit("exact"))).filter("kind is not null")
    return held.select(*DOC, "pos", "kind", F.coalesce("keeper", "first").alias("keeper")).distinct()


def by_document(dropped: DataFrame) -> DataFrame:
    """(doc_id, d0, d1, n_exact, n_near, positions, keepers); a document's own lines are all that is gathered for it."""
    count = lambda kind: F.count_if(F.col("kind") == kind).alias(f"n_{kind}")
    return dropped.groupBy(*DOC).agg(count("exact"), count("near"), F.collect_list("pos").alias("positions"), F.sort_array(F.collect_set("keeper.doc_id")).alias("keepers"))


def on_document(given: DataFrame) -> tuple[DataFrame, Column]:
    """by_document's rows with other names, and their equality with keyed documents."""
    renamed = given.withColumnsRenamed({c: f"of_{c}" for c in DOC})
    return renamed, F.col("doc_id").eqNullSafe(F.col("of_doc_id")) & (F.col("d0") == F.col("of_d0")) & (F.col("d1") == F.col("of_d1"))


def dedup_lines(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", edits: int = EDITS, words_per_edit: int = WORDS_PER_EDIT, least_words: int = LEAST_WORDS) -> DataFrame:
    """docs with the text without its dropped lines, and with n_exact and n_near.

    A line stays where it first stands (by id, then place); its exact copies go, within a document and across. A line also
    goes, everywhere, if a line within `edits` word edits of it stands earlier and the shorter of both has words_per_edit words
    for each edit. Lines are compared by their words, parted by blanks of any number; blank lines stay. A line of fewer than
    least_words words goes only if it stands earlier in its own document. With one edit, buckets of very many lines are
    split until all in one are near its earliest; with more edits their pairs are all verified, which takes time in
    proportion to the square of a bucket.

    Null texts stay null and empty ones empty; null ids come first; repeated rows are one document and keep or lose the same
    lines; very long texts and lines are read whole; an empty table gives an empty result. Columns of docs that clash with
    n_exact and n_near are replaced.
    """
    own = docs.withColumns({"d0": text_key(F.coalesce(F.col(text), F.lit("")))[0], "d1": text_key(F.coalesce(F.col(text), F.lit("")))[1]})
    found = written(by_document(dropped_lines(keyed(docs, text, doc_id), edits=edits, words_per_edit=words_per_edit, least_words=least_words)), "dropped")
    renamed = found.drop("keepers").withColumnsRenamed({"doc_id": "of_doc_id", "d0": "of_d0", "d1": "of_d1", "n_exact": "of_exact", "n_near": "of_near", "positions": "of_positions"})
    held = own.join(renamed, F.col(doc_id).cast("long").eqNullSafe(F.col("of_doc_id")) & (F.col("d0") == F.col("of_d0")) & (F.col("d1") == F.col("of_d1")), "left")
    lines = F.split(F.col(text), "\n", -1)
    # The outer lambda binds the lines, so a text is split once however many lines stay.
    stays = lambda ls: F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), "of_positions")
    joined = F.transform(F.array(lines), lambda ls: F.array_join(F.transform(stays(ls), lambda i: F.get(ls, i)), "\n"))
    clean = F.when(F.col("of_positions").isNull(), F.col(text)).otherwise(F.element_at(joined, 1))
    return held.withColumn(text, clean).withColumns({"n_exact": F.coalesce("of_exact", F.lit(0)), "n_near": F.coalesce("of_near", F.lit(0))}).drop("d0", "d1", "of_doc_id", "of_d0", "of_d1", "of_exact", "of_near", "of_positions")


def op6_line_dedup(spark, sf_dir):
    """For each document how many lines go, and the documents that keep the lines it loses."""
    docs = keyed(table(spark, sf_dir, "documents"), "text", "doc_id")
    found, equal = on_document(by_document(dropped_lines(docs)))
    rows = docs.select(*DOC, F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"))
    held = rows.join(found, equal, "left")
    return held.select("doc_id", "n_lines", F.coalesce("n_exact", F.lit(0)).cast("long").alias("n_exact"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.coalesce(F.array_join(F.col("keepers").cast("array<string>"), ","), F.lit("")).alias("keepers"))


# One word edit: the lines without the word at one place are equal (another word there), or one line is the other without a word.
OP6_SQL = r"""
WITH t AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10)))))::INT AS pos FROM documents
), w AS (
  SELECT doc_id, pos, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w FROM t
), o AS (
  SELECT doc_id, pos, w, len(w) AS n, array_to_string(w, ' ') || chr(10) || CASE WHEN len(w) < 3 THEN doc_id::VARCHAR ELSE '' END AS name FROM w WHERE len(w) > 0
), f AS (
  SELECT name, any_value(w) AS w, any_value(n) AS n, min((doc_id, pos)) AS first FROM o GROUP BY name
), v AS (
  SELECT name, n, first, p, hash(array_to_string(w[:p - 1] || w[p + 1:], ' ')) AS rest FROM (SELECT *, unnest(range(1, n + 1)) AS p FROM f WHERE n >= 8)
), g AS (
  SELECT n, p, rest, min(first) AS low FROM v GROUP BY ALL
), pairs AS (
  SELECT v.name, g.low AS keeper FROM v JOIN g USING (n, p, rest) WHERE g.low < v.first
  UNION ALL SELECT v.name, f.first FROM v JOIN f ON v.rest = hash(array_to_string(f.w, ' ')) AND v.n = f.n + 1 AND f.n >= 8 WHERE f.first < v.first
  UNION ALL SELECT f.name, v.first FROM v JOIN f ON v.rest = hash(array_to_string(f.w, ' ')) AND v.n = f.n + 1 AND f.n >= 8 WHERE v.first < f.first
), near AS (
  SELECT name, min(keeper) AS keeper FROM pairs GROUP BY name
), goes AS (
  SELECT o.doc_id, near.name IS NOT NULL AS is_near, coalesce(near.keeper, f.first)[1] AS keeper FROM o JOIN f USING (name) LEFT JOIN near USING (name) WHERE near.name IS NOT NULL OR (o.doc_id, o.pos) <> f.first
), k AS (
  SELECT doc_id, count(*) FILTER (NOT is_near) AS n_exact, count(*) FILTER (is_near) AS n_near, array_to_string(list_sort(list_distinct(list(keeper))), ',') AS keepers FROM goes GROUP BY doc_id
)
SELECT documents.doc_id, len(string_split(coalesce(text, ''), chr(10)))::BIGINT AS n_lines, coalesce(n_exact, 0)::BIGINT AS n_exact, coalesce(n_near, 0)::BIGINT AS n_near, coalesce(keepers, '') AS keepers FROM documents LEFT JOIN k ON documents.doc_id = k.doc_id
"""
