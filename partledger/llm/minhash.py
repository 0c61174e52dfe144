"""Operator 8: near-duplicates by circulant MinHash, banding and exact Jaccard verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partledger.llm.common import TEXTS_AT_ONCE, small, table, written
from partledger.llm.components import components
from partledger.operators.graph import shared_key_components

#: Words in a shingle, and the least similarity in percent, unless a contract says otherwise.
SHINGLE, PERCENT = 5, 80
#: Bands of the signature and coordinates in a band. A pair at 0.8 is missed with a chance of (1 - 0.8**5)**32 = 3e-6.
BANDS, ROWS = 32, 5
#: Buckets of up to so many members are compared in pairs, larger ones by their members' differences from a centre.
PAIRS = 32
#: Members of a large group from which the order of its shingles is taken, about.
ORDERED_BY = 128

FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
C1, C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * C1
    x = (x ^ (x >> np.uint64(27))) * C2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, computed once for each word; emptied when it holds very many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: str | None, size: int, hashes: WordHashes) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles; one for the whole sequence if it has fewer words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()
    if not words:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size = min(size, len(words))
    out = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        out = mix64(out * C2 + each[k : len(each) - size + 1 + k])
    return np.unique(out)


def signature(shingles: np.ndarray, n: int) -> np.ndarray:
    """n coordinates from two permutations of 32-bit numbers: the first deals the shingles out; the second, circularly
    shifted by k, gives coordinate k as the least of its values."""
    first = (mix64(shingles) >> np.uint64(32)).astype(np.uint32)
    low = np.full(n, 0xFFFFFFFF, np.uint32)
    shift = np.arange(n, dtype=np.uint32)
    for at in range(0, len(first), 256):  # few enough to stay in the processor's cache
        x = first[at : at + 256, None] + shift
        x *= np.uint32(0x85EBCA6B)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0xC2B2AE35)
        np.minimum(low, x.min(axis=0), out=low)
    return low


def features(docs: DataFrame, shingle: int, bands: int, rows: int, text: str, doc_id: str) -> DataFrame:
    """(doc_id, n_shingles, set_id, bands): set_id is a 128-bit digest of the whole set, bands has a hash for each band."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        seeds = mix64(np.arange(1, bands + 1, dtype=np.uint64))
        for part in batches:
            n, ids, keys = [], [], []
            for t in part.column("text"):
                s = shingle_set(t.as_py(), shingle, hashes)
                n.append(len(s))
                ids.append(xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None)
                if not len(s):
                    keys.append(np.zeros(0, np.uint64))
                    continue
                coordinates = signature(s, bands * rows).reshape(bands, rows).astype(np.uint64)
                band = seeds.copy()
                for r in range(rows):
                    band = mix64(band * C1 + coordinates[:, r])
                keys.append(band)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), lists_of(keys)], ["doc_id", "n_shingles", "set_id", "bands"])

    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return given.mapInArrow(each, "doc_id long, n_shingles long, set_id string, bands array<long>")


def lists_of(arrays: list[np.ndarray]) -> pa.ListArray:
    """Arrays of 64-bit hashes as one Arrow column of lists of longs."""
    ends = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    values = np.concatenate([*arrays, np.zeros(0, np.uint64)]).astype(np.uint64).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))


def shingle_sets(docs: DataFrame, shingle: int, text: str, doc_id: str) -> DataFrame:
    """(doc_id, set_id, shingles): whole sets, as sorted 64-bit hashes."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for part in batches:
            for at in range(0, part.num_rows, 1024):
                few = part.slice(at, 1024)
                sets = [shingle_set(t.as_py(), shingle, hashes) for t in few.column("text")]
                ids = [xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([few.column("doc_id"), pa.array(ids, pa.string()), lists_of(sets)], ["doc_id", "set_id", "shingles"])

    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return given.mapInArrow(each, "doc_id long, set_id string, shingles array<long>")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets have 100 * |intersection| >= percent * |union|."""
    a = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("of_a"))
    b = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("of_b"))
    both = F.size(F.array_intersect("of_a", "of_b"))
    # The same as 100 * both >= percent * (|a| + |b| - both), with one mention of the intersection.
    return pairs.join(a, "a").join(b, "b").filter((100 + percent) * both >= percent * (F.size("of_a") + F.size("of_b"))).select("a", "b")


def ordered(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def centred(open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(group, rep, w, delta, low_w, low_rep) of the members of large buckets (bucket, rep).

    Members joined by buckets are a group. Its centre is the set of the shingles that more than half of the members of its
    largest bucket hold, and delta is where a member differs from the centre. For members a and b, |a - b| + |b - a| is
    the number of shingles in just one of their deltas: |delta a| + |delta b| - 2 |both|. The pair is linked if that is
    at most (100 - percent) / (100 + percent) of |a| + |b|, so with w = (100 + percent) |delta| - (100 - percent) |set|, if
    w(a) + w(b) <= 2 (100 + percent) |both|. low_w is the group's least w, low_rep a member that has it. Deltas are in one order
    for the whole group: shingles that many of some ORDERED_BY of its members have come last, by how many do, the others by their
    hashes. Any order gives the same links; one by rising frequency gives few candidates.
    """
    groups = shared_key_components(open_, "rep", "bucket").withColumnRenamed("component", "group")
    crowd = open_.join(small(groups.withColumnRenamed("node", "rep")), "rep").groupBy("group", "bucket").agg(F.count("*").alias("crowd"))
    home = crowd.groupBy("group").agg(F.max(F.struct("crowd", "bucket")).alias("h")).select(F.col("h.bucket").alias("bucket"), "group", F.col("h.crowd").alias("crowd"))
    asked = open_.join(small(home), "bucket").select("rep", "group", F.lit(1).alias("home"), F.lit(0).alias("dealt"))
    large = groups.join(small(groups.groupBy("group").agg(F.count("*").alias("of"))), "group").filter(F.pmod(F.xxhash64("node"), F.col("of")) < ORDERED_BY)
    asked = asked.unionByName(large.select(F.col("node").alias("rep"), "group", F.lit(0).alias("home"), F.lit(1).alias("dealt")))
    asked = written(asked.groupBy("rep", "group").agg(F.max("home").alias("home"), F.max("dealt").alias("dealt")), "at-home")
    held = sets.join(small(asked), "rep").select("group", "home", "dealt", F.explode("shingles").alias("shingle"))
    at = held.groupBy("group", "shingle").agg(F.sum("home").alias("holders"), F.sum("dealt").alias("f"))
    at = at.join(small(asked.groupBy("group").agg(F.sum("home").alias("crowd"), F.sum("dealt").alias("of"))), "group").withColumn("f", F.expr("least(f, of - f)"))
    centre = F.collect_list(F.when(F.expr("2 * holders > crowd"), F.col("shingle"))).alias("centre")
    often = F.sort_array(F.collect_list(F.when(F.expr("f > 1 and 64 * f > of"), F.struct("f", "shingle")))).alias("often")
    centre = written(at.filter("2 * holders > crowd or (f > 1 and 64 * f > of)").groupBy("group").agg(centre, often).withColumn("often", F.col("often.shingle")), "centres")
    members = sets.join(small(groups.withColumnRenamed("node", "rep")), "rep").join(centre, "group", "left")
    middle, often = (F.coalesce(c, F.array().cast("array<bigint>")) for c in ("centre", "often"))
    members = members.select("group", "rep", F.size("shingles").cast("long").alias("n"), F.concat(F.array_except("shingles", middle), F.array_except(middle, "shingles")).alias("delta"), often.alias("often"))
    members = members.select("group", "rep", "n", F.concat(F.sort_array(F.array_except("delta", "often")), F.array_intersect("often", "delta")).alias("delta"))
    members = written(members.withColumn("w", (100 + percent) * F.size("delta").cast("long") - (100 - percent) * F.col("n")).drop("n"), "deltas")
    low = members.groupBy("group").agg(F.min(F.struct("w", "rep")).alias("low")).select("group", F.col("low.w").alias("low_w"), F.col("low.rep").alias("low_rep"))
    return members.join(small(low), "group")


def delta_links(members: DataFrame, percent: int, within_rest: bool | str) -> DataFrame:
    """(a, b): the linked pairs of a group's rest (members with w + low_w > 0) with its other members, or also within the rest
    (within_rest may name a column that says so for each group).

    Such a pair has to share (w(a) + w(b)) / (2 (100 + percent)) shingles of its deltas, one at least. What just one of its deltas has
    is its sets' difference, (100 - percent) / percent of either set at most. So the first shingle that both deltas have, in
    the group's order, has no more than so many before it in either: only such prefixes are unfolded, and pairs that meet there
    are confirmed on whole deltas.
    """
    unit = 2 * (100 + percent)
    members = members.withColumns({"rest": F.col("w") + F.col("low_w") > 0, "within": F.lit(within_rest) if isinstance(within_rest, bool) else F.col(within_rest), "size": F.size("delta").cast("long")})
    # What a pair shares is in both deltas, so neither's w is more than what the other's whole delta, if it has any, would allow (most).
    of = members.filter("size > 0").withColumn("most", unit * F.col("size") - F.col("w"))
    sides = {"rest": F.col("rest"), "other": F.col("within") | ~F.col("rest")}
    bounds = of.groupBy("group").agg(*(f(F.when(c, F.col(v))).alias(f"{n}_{v}") for n, c in sides.items() for f, v in ((F.min, "w"), (F.max, "most"))))
    of = of.join(small(bounds), "group")

    def prefix(side: Column, others: str) -> Column:
        """The length of a member's prefix on a side, 0 if it can't have a link with the others."""
        meets = side & (F.col("w") <= F.col(f"{others}_most")) & (F.col(f"{others}_w") <= F.col("most"))
        need = F.greatest(F.ceil((F.col("w") + F.col(f"{others}_w")) / unit), F.lit(1))
        apart = F.floor(((100 + percent) * F.col("size") - F.col("w")) / percent)  # (100 - percent) / percent of the set
        return F.when(meets, F.least(F.col("size") - need, apart) + 1).otherwise(0).cast("int")

    of = of.withColumns({"x_long": prefix(sides["rest"], "other"), "y_long": prefix(sides["other"], "rest")}).withColumn("long", F.greatest("x_long", "y_long"))
    placed = F.transform(F.slice("delta", F.lit(1), F.col("long")), lambda e, i: F.struct(e.alias("e"), i.alias("place")))
    each = of.filter("long > 0").select("group", "rep", "w", "rest", "size", "x_long", "y_long", placed.alias("delta"))
    each = written(each.withColumn("delta", F.explode("delta")).select("group", "rep", "w", "rest", "size", "x_long", "y_long", "delta.e", "delta.place"), "differences")
    met = lambda s: each.filter(f"place < {s}_long").select("group", "e", *(F.col(c).alias(f"{s}_{c}") for c in ("rep", "w", "rest", "size", "place")))
    left = F.least(F.col("x_size") - F.col("x_place"), F.col("y_size") - F.col("y_place"))
    once = ~F.col("y_rest") | (F.col("x_rep") < F.col("y_rep"))
    found = met("x").join(met("y"), ["group", "e"]).filter(once & (unit * left >= F.col("x_w") + F.col("y_w")))
    found = written(found.select("group", "x_rep", "y_rep").distinct(), "candidates")
    side = lambda s: members.select("group", *(F.col(c).alias(f"{s}_{c}") for c in ("rep", "w", "delta")))
    both = found.join(side("x"), ["group", "x_rep"]).join(side("y"), ["group", "y_rep"])
    return both.filter(unit * F.size(F.array_intersect("x_delta", "y_delta")) >= F.col("x_w") + F.col("y_w")).select(*ordered("x_rep", "y_rep"))


def crowd_links(open_: DataFrame, sets: DataFrame, percent: int) -> list[DataFrame]:
    """Tables of links (a, b) that join all linked members of large buckets (bucket, rep), without pairing each with each.

    Members whose w and the group's least w sum to 0 or less are linked with the one that has the least; any two of those
    that are near the centre are joined by that. Links of the rest with them are looked up; then the rest is grouped and
    centred anew. Of a group that a round takes less than a tenth of, links within the rest are looked up as well, and it is done
    with, so a group that has no centre is unfolded once, whatever the others do.
    """
    links = []
    while True:
        members = written(centred(open_, sets, percent), "members")
        near = members.filter("w + low_w <= 0")
        links.append(near.filter("rep <> low_rep").select(*ordered("rep", "low_rep")))
        of_group = members.groupBy("group").agg(F.count("*").alias("everyone"), F.count_if(F.expr("w + low_w > 0")).alias("left"))
        members = members.join(small(of_group.select("group", "left", F.expr("10 * left > 9 * everyone").alias("last"))), "group").filter("left > 0")
        if members.limit(1).count() == 0:
            return links
        links.append(written(delta_links(members, percent, "last"), "links"))
        rest = written(members.filter("w + low_w > 0 and not last").select("rep"), "rest")
        inside = open_.join(small(rest), "rep")
        several = inside.groupBy("bucket").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).filter("low <> high").select("bucket")
        open_ = written(inside.join(small(several), "bucket", "left_semi"), "open")
        if open_.limit(1).count() == 0:
            return links


def near_duplicates(docs: DataFrame, *, shingle: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, pairs: int = PAIRS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs.

    Texts with equal shingle sets are one class, which the smallest doc_id stands for. Class representatives that
    share a band of their signatures are candidates. In buckets of up to `pairs` members all are compared whose sizes allow
    the similarity, and a link counts only after it is confirmed on the whole sets. In larger buckets members are held against a
    common centre, which is exact too (see centred) and takes work in proportion to the members and their differences.

    Texts that are null or have no words have no shingles, link with nothing and are kept. Rows with a null id count
    as id null: they link by their text, and where a whole class has null ids, its component is null and it is
    kept. Repeated rows share one component; kept is true for each row whose id is the component's. Very long texts are read
    whole (a set is one row of 8 bytes a shingle). An empty table gives an empty result. Other columns are not read.
    """
    feats = written(features(docs, shingle, bands, rows, text, doc_id), "minhash", TEXTS_AT_ONCE)
    known = feats.filter(F.col("set_id").isNotNull() & F.col("doc_id").isNotNull())
    classes = known.groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    classes = written(classes, "classes")
    entries = classes.select("rep", "n", F.explode("bands").alias("bucket"))
    several = written(entries.groupBy("bucket").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).filter("low <> high").select("bucket"), "several")
    entries = written(entries.join(small(several), "bucket", "left_semi"), "entries")
    # Near copies share most of their bands: of buckets with the same members (by count, ends and 128 bits) one is kept.
    content = [F.min("rep").alias("low"), F.max("rep").alias("high"), F.bit_xor(F.xxhash64("rep")).alias("x0"), F.bit_xor(F.xxhash64(F.lit("members"), "rep")).alias("x1")]
    crowded = entries.groupBy("bucket").agg(F.count("*").alias("members"), *content)
    crowded = crowded.groupBy("members", "low", "high", "x0", "x1").agg(F.min("bucket").alias("bucket")).select("bucket", "members")
    entries = written(entries.join(small(crowded), "bucket"), "buckets")

    ids = written(entries.select("rep").distinct().join(classes.select("rep", "set_id"), "rep"), "involved")
    whole = shingle_sets(docs.join(small(ids.select(F.col("rep").alias(doc_id)).distinct()), doc_id, "left_semi"), shingle, text, doc_id)
    sets = written(whole.join(ids, (whole.doc_id == ids.rep) & (whole.set_id == ids.set_id), "left_semi").select(F.col("doc_id").alias("rep"), "set_id", "shingles").dropDuplicates(["rep", "set_id"]).select("rep", "shingles"), "sets", TEXTS_AT_ONCE)

    fits = 100 * F.least("n", "other_n") >= percent * F.greatest("n", "other_n")
    few = entries.filter(F.col("members") <= pairs)
    mates = few.select("bucket", F.col("rep").alias("other"), F.col("n").alias("other_n"))
    close = few.join(mates, "bucket").filter((F.col("rep") < F.col("other")) & fits).select(*ordered("rep", "other"))
    links = written(verified(close.distinct(), sets, percent), "links")
    crowds = entries.filter(F.col("members") > pairs).select("bucket", "rep")
    if crowds.limit(1).count():
        for more in crowd_links(crowds, sets, percent):
            links = links.unionByName(more)
    labels = components(links)

    reps = classes.select("set_id", "rep")
    of_set = reps.join(labels, reps.rep == labels.node, "left").select("set_id", F.coalesce("component", "rep").alias("component_id"))
    found = feats.drop("bands").join(of_set, "set_id", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op8_near_duplicates(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80)


OP8_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT r, hash(sh) AS sh FROM (SELECT r, unnest(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS sh FROM d)
), n AS (
  SELECT r, count(*) AS n FROM s GROUP BY r
), l AS (
  SELECT a.r AS ra, b.r AS rb FROM s a JOIN s b ON a.sh = b.sh AND a.r < b.r JOIN n na ON na.r = a.r JOIN n nb ON nb.r = b.r AND 100 * least(na.n, nb.n) >= 80 * greatest(na.n, nb.n)
  GROUP BY a.r, b.r HAVING 180 * count(*) >= 80 * (any_value(na.n) + any_value(nb.n))
), e AS (
  SELECT da.doc_id AS a, db.doc_id AS b FROM l JOIN d da ON da.r = ra JOIN d db ON db.r = rb
), both_ways AS (
  SELECT a, b FROM e UNION SELECT b, a FROM e
), reach AS (
  SELECT a AS x, a AS y FROM both_ways UNION SELECT x, b FROM reach JOIN both_ways ON y = a
), c AS (
  SELECT x, min(y) AS component_id FROM reach GROUP BY x
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id, doc_id = coalesce(component_id, doc_id) AS kept FROM d LEFT JOIN n USING (r) LEFT JOIN c ON c.x = doc_id
"""
