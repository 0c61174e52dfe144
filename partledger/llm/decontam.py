"""Operator 4: benchmark decontamination with one Aho-Corasick automaton over normalised items."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from partledger.llm.common import small, table, written

#: Consecutive item words that make a window.
WINDOW = 10
#: Bytes of item texts that one automaton is built from: some 60 times that in a worker's memory. More items are
#: scanned for in further passes over the rows, one after the other.
PASS_BYTES = 4 << 20

#: Each byte of UTF-8 text as normalised: A-Z in lower case, other ASCII but 0-9 and a-z a space, the rest as it is.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def folded(text: str | None) -> bytes:
    """The normalised UTF-8 bytes of a text; byte i stands for byte i of the original."""
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD)


class Items:
    """The items of one pass, and the automaton over their windows: built once in each worker, from numbers of words."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        self.items, self.window = items, window
        self.numbers: dict[bytes, int] = {}
        self.automaton, self.shortest = None, 0

    def windows(self, text: str | None) -> list[tuple[int, ...]]:
        words = tuple(self.numbers.setdefault(w, len(self.numbers) + 1) for w in folded(text).split())
        if not words:
            return []
        return [words[i : i + self.window] for i in range(max(1, len(words) - self.window + 1))]

    def build(self) -> Items:
        import ahocorasick

        if self.automaton is None:
            holders: dict[tuple[int, ...], set[str]] = {}
            for item_id, text in self.items:
                for w in self.windows(text):
                    holders.setdefault(w, set()).add(item_id)
            self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
            for w, ids in holders.items():
                self.automaton.add_word(w, (len(w), sorted(ids)))
            if holders:
                self.automaton.make_automaton()
            self.shortest = min(map(len, holders), default=1 << 62)
        return self

    def __getstate__(self) -> dict:
        return {**self.__dict__, "automaton": None, "numbers": {}}

    def scan(self, text: str | None) -> tuple[int, np.ndarray, set[str]]:
        """(number of words, the numbers of the hit words, items with occurring windows).

        Words of no item are 0. No window goes over one, so only the runs between them that are as long as the shortest window
        are given to the automaton.
        """
        words = folded(text).split()
        if len(words) < self.shortest:
            return len(words), np.zeros(0, np.int64), set()
        known = np.fromiter(map(self.numbers.get, words, repeat(0)), np.int64, len(words))
        change = np.flatnonzero(np.diff(known != 0, prepend=False, append=False))
        ends, items = [], set()
        for start, stop in zip(change[::2], change[1::2], strict=True):
            if stop - start >= self.shortest:
                for end, (n, ids) in self.automaton.iter(tuple(known[start:stop].tolist())):
                    ends.append((start + end + 1, n))
                    items.update(ids)
        if not ends:
            return len(words), np.zeros(0, np.int64), items
        at = np.asarray(ends, np.int64)
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, at[:, 0] - at[:, 1], 1)
        np.add.at(edge, at[:, 0], -1)
        return len(words), np.flatnonzero(np.cumsum(edge[:-1]) > 0), items


def original_spans(text: str | None, hit: np.ndarray) -> list[tuple[int, int]]:
    """Runs of hit words as (start, end) in code points of the original text, end exclusive."""
    raw = np.frombuffer(folded(text), np.uint8)
    inside = np.concatenate([[False], raw != 32, [False]])
    starts, ends = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(~inside[1:] & inside[:-1])
    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    breaks = np.flatnonzero(np.diff(hit) > 1)
    first, last = np.concatenate([[0], breaks + 1]), np.concatenate([breaks, [len(hit) - 1]])
    return [(int(points[starts[hit[a]]]), int(points[ends[hit[b]]])) for a, b in zip(first, last, strict=True)]


def item_passes(items: DataFrame, item_id: str, text: str, window: int, pass_bytes: int) -> Iterator[Items]:
    """The items in groups of about pass_bytes of text each; the driver holds one group at a time. One group at least."""
    rows = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item_id"), F.col(text).alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    passes = int(total // pass_bytes) + 1
    for k in range(passes):
        part = rows if passes == 1 else rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k)
        yield Items([(r[0], r[1]) for r in part.collect()], window)


FOUND = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, item_ids array<string>, hit_spans array<struct<start: int, end: int>>"


def report(texts: pa.Array, n_words: list[int], hits: list[np.ndarray], ids: list[list[str]]) -> list[pa.Array]:
    """The columns of FOUND."""
    spans = [[{"start": a, "end": b} for a, b in original_spans(t.as_py(), h)] if len(h) else [] for t, h in zip(texts, hits, strict=True)]
    return [
        pa.array(n_words, pa.int64()), pa.array([len(h) for h in hits], pa.int64()), pa.array([len(i) for i in ids], pa.int64()),
        pa.array([hashlib.sha256(",".join(i).encode()).hexdigest() for i in ids], pa.string()), pa.array([len(h) > 0 for h in hits], pa.bool_()),
        pa.array(ids, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
    ]


def scan_for_items(docs: DataFrame, items: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """docs with n_words, n_hit, n_items, items_sha256, contaminated, item_ids (array) and hit_spans (array of structs).

    Each partition scans its texts once against one automaton, and nothing is shuffled. Items of more than pass_bytes are
    looked for pass by pass over one copy of the rows in the shared folder; a pass broadcasts its own items only and leaves a row
    for each row with hits, which are joined to the copy in the end. A null or empty text has no words and no hits; an
    item without words has no window; items with a null id are known as "null"; repeated items count once by id; repeated
    documents each get their row; very long texts are scanned whole; an empty table of items leaves all documents clean, one of
    documents gives an empty result. Columns of docs whose names clash with the new ones are replaced.
    """
    spark = docs.sparkSession
    new = T.StructType.fromDDL(FOUND).fields
    names = [f.name for f in new]
    out = docs.drop(*names, "_row", "_hit", "_items")
    passes = item_passes(items, item_id, item_text, window, pass_bytes)
    group, more = next(passes), next(passes, None)
    if more is None:
        sent = spark.sparkContext.broadcast(group)

        def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = sent.value.build()
            for part in batches:
                scanned = [found.scan(t.as_py()) for t in part.column(text)]
                columns = report(part.column(text), [s[0] for s in scanned], [s[1] for s in scanned], [sorted(s[2]) for s in scanned])
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], [*part.schema.names, *names])

        return out.mapInArrow(once, T.StructType([*out.schema.fields, *new]))

    copy = written(out.withColumn("_row", F.monotonically_increasing_id()), "scanned")
    hits = None
    while group is not None:
        sent = spark.sparkContext.broadcast(group)

        def one_pass(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            found = sent.value.build()
            for part in batches:
                scanned = [(r, *found.scan(t.as_py())) for r, t in zip(part.column("_row"), part.column(text), strict=True)]
                scanned = [(r, hit, ids) for r, _, hit, ids in scanned if ids]
                columns = [pa.array([r.as_py() for r, _, _ in scanned], pa.int64()), pa.array([h.astype(np.int32) for _, h, _ in scanned], pa.list_(pa.int32())), pa.array([sorted(i) for _, _, i in scanned], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, ["_row", "_hit", "_items"])

        mine = written(copy.select("_row", text).mapInArrow(one_pass, "_row long, _hit array<int>, _items array<string>"), "hits")
        hits = mine if hits is None else hits.unionByName(mine)
        sent.destroy()
        group, more = more, next(passes, None)
    # A row has one entry for each pass at most.
    of_row = hits.groupBy("_row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("_hit")))).alias("_hit"), F.array_distinct(F.flatten(F.collect_list("_items"))).alias("_items"))
    held = copy.join(small(of_row), "_row", "left").drop("_row")

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            texts = part.column(text)
            hits = [np.asarray(h.as_py() or [], np.int64) for h in part.column("_hit")]
            columns = report(texts, [len(folded(t.as_py()).split()) for t in texts], hits, [sorted(i.as_py() or []) for i in part.column("_items")])
            yield pa.RecordBatch.from_arrays([*part.columns[:-2], *columns], [*part.schema.names[:-2], *names])

    return held.mapInArrow(merged, T.StructType([*out.schema.fields, *new]))


def op4_decontaminate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan_for_items(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


OP4_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), iw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[p : p + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS p FROM i WHERE len(w) > 0)
), dw AS (
  SELECT r, p, n, array_to_string(w[p : p + n - 1], ' ') AS win
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)
), m AS (
  SELECT r, p, dw.n, item_id FROM dw JOIN iw ON dw.win = iw.win AND dw.n = iw.n
), h AS (
  SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS x FROM (SELECT DISTINCT r, p, n FROM m)) GROUP BY r
), s AS (
  SELECT r, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT r, item_id FROM m) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN s USING (r)
"""
