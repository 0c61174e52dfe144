"""Operator 12: codes of vectors by parts, from whole-number codebooks that Elkan's form of Lloyd's rounds has moved.

A vector's components become whole numbers, which are cut into equal consecutive parts; each part gets the number of the nearest
entry of its codebook. Bounds of all distances are kept in a table, and shifted by how far entries have moved; only what the
triangle inequality strictly rules out is not compared, and everything else is decided in whole numbers, ties included.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from partledger.llm.common import small, table, written

#: Parts of a vector, entries of a part's codebook (256 at most), rounds, and what components are multiplied by.
PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Rounds after which the table of bounds is written anew from the shifted ones; before that bounds are shifted by the way from
#: the entries that the table was made with, which is never longer than the sum of the ways of single rounds.
REFRESH = 4
#: A lower bound is kept as so many sixteenths of the entries' mean distance above the upper bound, rounded down: four bits.
MOST = 15
#: Bounds are floating-point numbers; what they rule out has to be farther by this share, and by this, than rounding errors are.
SLACK = 1e-5


class Codebooks:
    """The entries of all parts, as they are and as they were when the table of bounds was made."""

    def __init__(self, then: np.ndarray, now: np.ndarray):
        """Both (parts, entries, components) of whole numbers."""
        self.then, self.now = then, now
        between = lambda c: np.sqrt(((c[:, :, None] - c[:, None]) ** 2).sum(-1).astype(np.float64))
        self.step = np.maximum(between(then).mean((1, 2)), 1.0) / (MOST + 1)
        self.moved = np.sqrt(((now - then) ** 2).sum(-1).astype(np.float64))
        self.half = between(now) / 2

    def first(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(entry, upper bound, lower bounds in steps above it) of the parts of new vectors, from all distances."""
        n, parts, _ = x.shape
        entry, upper = np.zeros((n, parts), np.uint8), np.zeros((n, parts), np.float32)
        above = np.zeros((n, parts, self.now.shape[1]), np.uint8)
        for p in range(parts):
            d = ((x[:, p, None] - self.then[p][None]) ** 2).sum(-1)
            entry[:, p] = d.argmin(1)
            self.bound(p, np.sqrt(d.min(1).astype(np.float64)), np.sqrt(d.astype(np.float64)), upper, above)
        return entry, upper, above

    def bound(self, p: int, own: np.ndarray, lower: np.ndarray, upper: np.ndarray, above: np.ndarray) -> None:
        upper[:, p] = own
        above[:, p] = np.clip(np.floor((lower - own[:, None]) / self.step[p]), 0, MOST)

    def assign(self, x: np.ndarray, entry: np.ndarray, upper: np.ndarray, above: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, list[np.ndarray]]:
        """(entry, squared distance, distances taken, lower bounds of each part) of the parts of vectors as entries are now."""
        n, parts, _ = x.shape
        found, error, taken, lowers = np.zeros((n, parts), np.uint8), np.zeros((n, parts), np.int64), 0, []
        for p in range(parts):
            now, was, entries = self.now[p], entry[:, p].astype(np.int64), self.now.shape[1]
            own = ((x[:, p] - now[was]) ** 2).sum(-1)
            reach = (np.sqrt(own.astype(np.float64)) * (1 + SLACK) + SLACK)[:, None]
            lower = upper[:, p, None].astype(np.float64) + above[:, p] * self.step[p] - self.moved[p]
            near = (lower * (1 - SLACK) - SLACK <= reach) & (self.half[p][was] <= reach)
            near[np.arange(n), was] = False
            row, other = np.nonzero(near)
            d = ((x[row, p] - now[other]) ** 2).sum(-1)
            best = own * entries + was  # ties go to the lower number
            if len(row):
                firsts = np.flatnonzero(np.diff(row, prepend=-1))
                best[row[firsts]] = np.minimum(best[row[firsts]], np.minimum.reduceat(d * entries + other, firsts))
            found[:, p], error[:, p] = best % entries, best // entries
            taken += n + len(row)
            lower = np.maximum(lower, 0)
            lower[row, other] = np.sqrt(d.astype(np.float64))
            lower[np.arange(n), was] = np.sqrt(own.astype(np.float64))
            lowers.append(lower)
        return found, error, taken, lowers


def packed(above: np.ndarray) -> np.ndarray:
    """Numbers of four bits, two in a byte."""
    flat = above.reshape(len(above), -1)
    flat = np.pad(flat, ((0, 0), (0, flat.shape[1] % 2)))
    return flat[:, ::2] << 4 | flat[:, 1::2]


def unpacked(raw: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    both = np.stack([raw >> 4, raw & 15], -1).reshape(len(raw), -1)
    return both[:, : int(np.prod(shape))].reshape(len(raw), *shape)


def to_binary(rows: np.ndarray) -> pa.Array:
    """An array with one row of bytes for each row of numbers."""
    rows = np.ascontiguousarray(rows)
    width = rows.itemsize * int(np.prod(rows.shape[1:]))
    offsets = pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int32) * np.int32(width))
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, offsets, pa.py_buffer(rows)])


def from_binary(column: pa.Array, kind: type, shape: tuple[int, ...]) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), *shape)


def from_lists(column: pa.Array, parts: int) -> np.ndarray:
    """(rows, parts, components); numbers have to be small enough for squared distances of 54 bits."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    x = flat.reshape(len(column), parts, -1)
    if len(x) and 4.0 * x.shape[2] * float(max(x.max(), -x.min())) ** 2 >= 2.0**54:
        raise ValueError("components are too large for whole-number distances")
    return x


def slices(batches: Iterator[pa.RecordBatch], rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """Small pieces, so that one part's distances of a piece are some megabytes."""
    for part in batches:
        for i in range(0, len(part), rows):
            yield part.slice(i, rows)


STATE = "_entry binary, _upper binary, _above binary"


def with_bounds(rows: DataFrame, books: Codebooks, parts: int) -> DataFrame:
    names = [f.name for f in T.StructType.fromDDL(STATE)]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            entry, upper, above = books.first(from_lists(part.column("_x"), parts))
            yield pa.RecordBatch.from_arrays([*part.columns, to_binary(entry), to_binary(upper), to_binary(packed(above))], [*part.schema.names, *names])

    return rows.mapInArrow(each, T.StructType([*rows.schema.fields, *T.StructType.fromDDL(STATE)]))


def state_of(part: pa.RecordBatch, books: Codebooks) -> tuple[np.ndarray, ...]:
    parts, entries, _ = books.now.shape
    x = from_lists(part.column("_x"), parts)
    bytes_of = -(-parts * entries // 2)
    above = unpacked(from_binary(part.column("_above"), np.uint8, (bytes_of,)), (parts, entries))
    return x, from_binary(part.column("_entry"), np.uint8, (parts,)), from_binary(part.column("_upper"), np.float32, (parts,)), above


def new_bounds(state: DataFrame, books: Codebooks) -> DataFrame:
    """The table of bounds for the entries as they are now, from the shifted ones and the distances that were taken."""
    after = Codebooks(books.now, books.now)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            x, entry, upper, above = state_of(part, books)
            found, error, _, lowers = books.assign(x, entry, upper, above)
            upper, above = np.zeros_like(upper), np.zeros_like(above)
            for p, lower in enumerate(lowers):
                after.bound(p, np.sqrt(error[:, p].astype(np.float64)), lower, upper, above)
            changed = {"_entry": to_binary(found), "_upper": to_binary(upper), "_above": to_binary(packed(above))}
            yield pa.RecordBatch.from_arrays([changed.get(c, part.column(c)) for c in part.schema.names], part.schema.names)

    return state.mapInArrow(each, state.schema)


def moved_entries(state: DataFrame, books: Codebooks) -> np.ndarray:
    """Each entry as the floor of the mean of its parts; an entry without any stays. A task leaves one row for each entry."""
    parts, entries, size = books.now.shape

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(parts * entries, np.int64), np.zeros((parts * entries, size), np.int64)
        for part in slices(batches):
            x, entry, upper, above = state_of(part, books)
            at = (books.assign(x, entry, upper, above)[0].astype(np.int64) + np.arange(parts) * entries).ravel()
            count += np.bincount(at, minlength=len(count))
            np.add.at(total, at, x.reshape(-1, size))
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used // entries, pa.int32()), pa.array(used % entries, pa.int32()), pa.array(count[used]), pa.array(list(total[used]), pa.list_(pa.int64()))], ["part", "entry", "n", "total"])

    sums = state.select("_x", "_entry", "_upper", "_above").mapInArrow(each, "part int, entry int, n long, total array<long>")
    # Totals are summed as decimals, which no number of rows overflows; entries are a fixed few.
    of_entry = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.col("total")[i].cast("decimal(38,0)")).alias(f"t{i}") for i in range(size)))
    now = books.now.copy()
    for r in of_entry.collect():
        now[r["part"], r["entry"]] = [int(r[f"t{i}"]) // r["n"] for i in range(size)]
    return now


def coded(state: DataFrame, books: Codebooks, keep: Sequence[str]) -> DataFrame:
    """(keep, code binary, error long)."""
    kept = [f for f in state.schema.fields if f.name in keep]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found, error, _, _ = books.assign(*state_of(part, books))
            yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), to_binary(found), pa.array(error.sum(1))], [*(f.name for f in kept), "code", "error"])

    return state.mapInArrow(each, T.StructType([*kept, *T.StructType.fromDDL("code binary, error long")]))


def vector_codes(
    rows: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", keep: Sequence[str] = ("vec_id",), parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, refresh: int = REFRESH
) -> tuple[DataFrame, np.ndarray]:
    """((keep, code binary: a byte for each part, error long: the squared distances), the codebooks (parts, entries, components)).

    The vectors and their bounds are written once to the shared folder, next to the columns of keep; each round reads them and
    sums by entry, and only codebooks come to the driver. Entries begin as the parts of the vectors with the smallest distinct
    ids (of rows with one id, the least vector; a null id is last); with fewer ids there are fewer entries. Rows whose vector is
    null or has components that are null or not finite are dropped; those with another number of components than the first id's
    vector, or one that parts doesn't divide, have null code and error and move nothing. Repeated rows each count and get a row. An
    empty table gives an empty result and codebooks without entries. Columns not in keep are not read, whatever their names.
    """
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    numbers = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    whole = rows.filter(F.col(vector).isNotNull() & F.coalesce(finite, F.lit(False))).select(*keep, F.col(vec_id).alias("_id"), numbers.alias("_x"))
    fits = (F.size("_x") > 0) & (F.size("_x") % parts == 0)
    firsts = lambda found: [tuple(r) for r in found.select("_id", F.size("_x")).distinct().orderBy(F.asc_nulls_last("_id"), "size(_x)").limit(entries).collect()]
    ids = firsts(whole.filter(fits))
    size = ids[0][1] if ids else 0
    alike, other = whole.filter(fits & (F.size("_x") == size)), whole.filter(~(fits & (F.size("_x") == size)))
    if any(n != size for _, n in ids):
        ids = firsts(alike)
    odd = other.select(*keep, F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error"))
    if not ids:
        return odd, np.zeros((parts, 0, 0), np.int64)
    wanted = F.col("_id").isin([i for i, _ in ids if i is not None]) | (F.col("_id").isNull() & F.lit(ids[-1][0] is None))
    least = {r[0]: r[1] for r in alike.filter(wanted).groupBy("_id").agg(F.min("_x")).collect()}
    start = np.array([least[i] for i, _ in ids], np.int64).reshape(len(ids), parts, -1).transpose(1, 0, 2)
    books, alike = Codebooks(start, start), alike.select(*keep, "_x")
    state = written(with_bounds(alike, books, parts), "bounds")
    for done in range(rounds):
        if done and done % refresh == 0:
            state, books = written(new_bounds(state, books), "bounds"), Codebooks(books.now, books.now)
        books = Codebooks(books.then, moved_entries(state, books))
    return coded(state, books, keep).unionByName(odd), books.now


def codebooks_digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def op12_vector_codes(spark, sf_dir):
    codes, books = vector_codes(table(spark, sf_dir, "embeddings"), keep=["vec_id", "label"])
    codes = written(codes.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label"), "codes")
    sums = codes.groupBy(F.col("label").alias("l")).agg(F.sum("error").alias("label_error"))
    held = codes.withColumnRenamed("label", "_l").join(small(written(sums, "label-errors")), F.col("_l").eqNullSafe(F.col("l")))
    return held.select("vec_id", "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))


def _round_sql(k: int) -> str:
    """Assignment to the entries c<k>, and the entries c<k + 1> that come of it."""
    distance = " + ".join(f"(x{i} - c.y{i}) * (x{i} - c.y{i})" for i in range(1, 5))
    means = ", ".join(f"CASE WHEN n IS NULL THEN c.y{i} ELSE (s{i} - ((s{i} % n) + n) % n) // n END AS y{i}" for i in range(1, 5))
    sums = ", ".join(f"sum(x{i})::BIGINT AS s{i}" for i in range(1, 5))
    return f"""
a{k} AS (SELECT r, p.part, min((({distance}) * 64 + entry)::BIGINT) AS best FROM p JOIN c{k} c ON p.part = c.part GROUP BY r, p.part),
m{k} AS (SELECT part, best % 64 AS entry, count(*) AS n, {sums} FROM a{k} JOIN p USING (r, part) GROUP BY part, best % 64),
c{k + 1} AS (SELECT c.part, c.entry, {means} FROM c{k} c LEFT JOIN m{k} m ON c.part = m.part AND c.entry = m.entry)"""


#: For vectors of 64 components.
OP12_SQL = f"""
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT r, part, x[part * 4 + 1] AS x1, x[part * 4 + 2] AS x2, x[part * 4 + 3] AS x3, x[part * 4 + 4] AS x4 FROM v, (SELECT unnest(range(16)) AS part)
), i AS (
  SELECT row_number() OVER (ORDER BY vec_id) - 1 AS entry, x FROM (SELECT vec_id, min(x) AS x FROM v GROUP BY vec_id ORDER BY vec_id LIMIT 64)
), c0 AS (
  SELECT part, entry, x[part * 4 + 1] AS y1, x[part * 4 + 2] AS y2, x[part * 4 + 3] AS y3, x[part * 4 + 4] AS y4 FROM i, (SELECT unnest(range(16)) AS part)
),{_round_sql(0)},{_round_sql(1)},{_round_sql(2)},
e AS (
  SELECT r, string_agg(printf('%02x', best % 64), '' ORDER BY part) AS code, sum(best // 64)::BIGINT AS error FROM a2 GROUP BY r
)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
  (SELECT sha256(string_agg(y1 || ',' || y2 || ',' || y3 || ',' || y4, ',' ORDER BY part, entry)) FROM c2) AS codebooks_sha256
FROM v JOIN e USING (r)
"""
