"""Operator 13: all runs of periodic words, from longest previous factors, Main's extensions at block borders and copied blocks.

A run is a stretch of words with smallest period q, of at least max(least, times * q) words, that no neighbouring word extends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from partledger.llm.common import WORD, table

#: The fewest words of a run, and the fewest times that its period goes into it.
LEAST, TIMES = 6, 4
#: Words whose runs are looked for at once, in texts one after the other; a longer text is taken alone, whole.
GROUP = 1 << 18
#: Pairs of a border and a period that are extended at once.
PAIRS = 1 << 18


def stretches(words: np.ndarray, part: np.ndarray, times: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, stretch of each): what is left when words that can be in no run are taken away.

    words are whole numbers from 0 and part, which never falls, is the text of each. A run of times * q words has each of its
    words times times, so a word that its stretch has less often ends that. Repeated until nothing goes; stretches below
    least words go as well.
    """
    at = np.arange(len(words))
    while len(at):
        _, of, count = np.unique(words[at] * (int(part[-1]) + 1) + part, return_inverse=True, return_counts=True)
        keep = count[of] >= times
        left, old = at[keep], part[keep]
        new = np.cumsum((np.diff(left, prepend=left[:1]) > 1) | (np.diff(old, prepend=old[:1]) > 0))
        long = np.bincount(new, minlength=1)[new] >= least
        if long.all() and keep.all():
            break
        at, part = left[long], new[long]
    return at, part


class Factors:
    """Names of all factors of 2^k letters of a string, hence its suffix array, and common extensions of any two places."""

    def __init__(self, letters: np.ndarray):
        """letters: whole numbers from 0; the last letter occurs once."""
        self.n = n = len(letters)
        self.names = [np.unique(letters, return_inverse=True)[1].astype(np.int64)]
        width = 1
        while int(self.names[-1].max()) < n - 1:
            name = self.names[-1]
            after = np.zeros(n, np.int64)
            after[: n - width] = name[width:] + 1
            self.names.append(np.unique(name * (n + 1) + after, return_inverse=True)[1].astype(np.int64))
            width *= 2
        self.rank = self.names[-1]
        self.order = np.empty(n, np.int64)
        self.order[self.rank] = np.arange(n)

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many letters from a on equal those from b on, for a < b; b may be n."""
        a, b, out = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            fits = b + (1 << k) <= self.n
            name = self.names[k]
            step = np.where(fits & (name[np.minimum(a, self.n - 1)] == name[np.minimum(b, self.n - 1)]), 1 << k, 0)
            a, b, out = a + step, b + step, out + step
        return out

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many letters before a equal those before b, for a < b."""
        a, b, out = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            width = 1 << k
            name = self.names[k]
            step = np.where((a >= width) & (name[np.maximum(a - width, 0)] == name[np.maximum(b - width, 0)]), width, 0)
            a, b, out = a - step, b - step, out + step
        return out

    def previous(self) -> tuple[list[int], list[int]]:
        """The longest previous factor of each place and where it begins, from the suffix array and its common prefixes.

        Places leave a list in the suffix array's order, the last first, so the neighbours of a place are then the nearest
        suffixes that begin before it.
        """
        n = self.n
        common = np.zeros(n + 1, np.int64)
        x, y = self.order[:-1], self.order[1:]
        common[1:n] = self.forward(np.minimum(x, y), np.maximum(x, y))
        shared, order, rank = common.tolist(), self.order.tolist(), self.rank.tolist()
        before, after = list(range(-1, n)), list(range(1, n + 2))
        length, source = [0] * n, [-1] * n
        for i in range(n - 1, -1, -1):
            r = rank[i]
            left, right = before[r], after[r]
            up, down = shared[r], shared[right]
            if up >= down:
                length[i], shared[right] = up, down
                if up:
                    source[i] = order[left]
            else:
                length[i], shared[right] = down, up
                source[i] = order[right]
            if left >= 0:
                after[left] = right
            before[right] = left
        return length, source


def border_runs(factors: Factors, starts: np.ndarray, times: int, least: int) -> dict[int, dict[int, int]]:
    """start -> end -> period of all runs that a border between two blocks is in or beside.

    A run [s, e) whose last letter is in the block at b, the one before beginning at c, has s > c - q: else the block at c
    would have been longer. So (times - 1) * q is less than both blocks' letters, and the pairs of borders and periods are
    no more than the letters. Main's extensions: the letters q apart are equal on a stretch through (b - q, b) or (b, b + q).
    """
    ends = np.append(starts[1:], factors.n)
    earlier = np.concatenate([[0], np.diff(starts)])
    most = (earlier + ends - starts) // (times - 1)
    found: dict[int, dict[int, int]] = {}
    upto = np.cumsum(most)
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + PAIRS, "right")))
        b = np.repeat(starts[first:last], most[first:last])
        q = np.arange(len(b)) - np.repeat(np.cumsum(most[first:last]) - most[first:last], most[first:last]) + 1
        for side in (0, 1):
            x, y = (b - q, b) if side == 0 else (b, b + q)
            ok = (x >= 0) & (y <= factors.n)
            x, y, p = x[ok], y[ok], q[ok]
            back, on = factors.backward(x, y), factors.forward(x, y)
            run = (back + on >= (times - 1) * p) & (back + on + p >= least)
            for s, e, period in zip((x - back)[run].tolist(), (y + on)[run].tolist(), p[run].tolist(), strict=True):
                mine = found.setdefault(s, {})
                mine[e] = min(period, mine.get(e, period))  # a stretch with a smaller period has all its multiples
        first = last
    return found


def all_runs(letters: np.ndarray, times: int, least: int) -> list[tuple[int, int, int]]:
    """(start, end, period) of every run of a string whose last letter occurs once, by start."""
    factors = Factors(letters)
    length, source = factors.previous()
    starts, i = [], 0
    while i < factors.n:
        starts.append(i)
        i += max(1, length[i])
    found = border_runs(factors, np.asarray(starts, np.int64), times, least)
    # A run inside a block, at no border, stands in the block's source as well; runs are kept by where they begin.
    for i in starts:
        end, shift = i + length[i], i - source[i]
        for s in range(i + 1, end - least):
            for e, period in found.get(s - shift, {}).items():
                if e + shift < end:
                    found.setdefault(s, {})[e + shift] = period
    return sorted((s, e, period) for s, ends in found.items() for e, period in ends.items())


def runs_of_texts(texts: list[list[bytes]], times: int, least: int) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each of some texts, given as words, by start and period."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    total = int(lengths.sum())
    if not total:
        return out
    numbers: dict[bytes, int] = {}
    words = np.fromiter((numbers.setdefault(w, len(numbers)) for text in texts for w in text), np.int64, total)
    begin = np.cumsum(lengths) - lengths
    text_of = np.repeat(np.arange(len(texts)), lengths)
    at, part = stretches(words, text_of, times, least)
    if not len(at):
        return out
    # The stretches one after the other, with a letter of its own behind each.
    place = np.arange(len(at)) + part
    letters = np.arange(len(at) + int(part[-1]) + 1) + len(numbers)
    letters[place] = words[at]
    word_at = np.zeros(len(letters), np.int64)
    word_at[place] = at
    for s, e, period in all_runs(letters, times, least):
        first = int(word_at[s])
        k = int(text_of[first])
        out[k].append((first - int(begin[k]), e - s, period))
    return [sorted(runs) for runs in out]


def kept_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run has after its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [w for w, inside in zip(words, np.cumsum(edge[:-1]).tolist(), strict=True) if not inside]


FOUND = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def periodic_runs(docs: DataFrame, *, text: str = "text", times: int = TIMES, least: int = LEAST) -> DataFrame:
    """docs with n_words, runs (array of structs, by start and period; places are numbers of words from 0) and collapsed: the
    text's words, joined by spaces, without those that repeat a run's first period.

    Each partition works on its own rows and nothing is shuffled. Whole texts are taken, of any length; a null or empty text
    has no words, no runs and an empty collapsed text; repeated rows each get theirs; an empty table gives an empty result. A
    stretch with more than one period is a run of the smallest. Columns of docs whose names clash with the new ones are
    replaced. times must be 2 or more.
    """
    new = T.StructType.fromDDL(FOUND).fields
    names = [f.name for f in new]
    out = docs.drop(*names)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            texts = part.column(text)
            first = 0
            while first < len(texts):
                group, held = [], 0
                while first + len(group) < len(texts) and (not group or held < GROUP):
                    group.append((texts[first + len(group)].as_py() or "").encode("utf-8", "surrogatepass").split())
                    held += len(group[-1])
                runs = runs_of_texts(group, times, least)
                columns = [
                    pa.array([len(w) for w in group], pa.int64()), pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in rs] for rs in runs], kind),
                    pa.array([b" ".join(kept_words(w, rs)).decode("utf-8", "surrogatepass") for w, rs in zip(group, runs, strict=True)], pa.string()),
                ]  # fmt: skip
                mine = part.slice(first, len(group))
                yield pa.RecordBatch.from_arrays([*mine.columns, *columns], [*mine.schema.names, *names])
                first += len(group)

    return out.mapInArrow(each, T.StructType([*out.schema.fields, *new]))


def greatest_exponent(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; the first of equals; null if there is none."""
    none = F.lit(None).cast("struct<start: long, length: long, period: long>")
    return F.aggregate(runs, none, lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text) that the query looks at: of a tenth of the documents (by crc32 of doc_id) the words from some place on are
    made periodic, by the contract's rule. A null doc_id or text changes nothing."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    held = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("words"))
    held = held.withColumn("n", F.nullif(F.size("words"), F.lit(0))).withColumn("g", F.floor(F.col("h") / 10))
    held = held.withColumn("a", F.col("g") % F.col("n")).withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    word = lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("words", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))  # noqa: E731
    return held.select("doc_id", F.when(F.col("n") > 0, F.array_join(F.transform("words", word), " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark, sf_dir):
    found = periodic_runs(planted(table(spark, sf_dir, "documents"))).withColumn("best", greatest_exponent(F.col("runs")))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))  # noqa: E731
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"), F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )  # fmt: skip


#: Pairs of equal words that stand q apart, for each q; stretches of neighbouring pairs are runs.
OP13_SQL = r"""
WITH RECURSIVE byte AS (
  SELECT b, c FROM (WITH RECURSIVE k(b, c, i) AS (SELECT b, b::BIGINT, 0 FROM range(256) t(b) UNION ALL SELECT b, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i + 1 FROM k WHERE i < 8) SELECT b, c FROM k WHERE i = 8)
), crc AS (
  SELECT DISTINCT doc_id, doc_id::VARCHAR AS s, 0 AS i, 4294967295::BIGINT AS c FROM documents WHERE doc_id IS NOT NULL
  UNION ALL SELECT doc_id, s, i + 1, xor(crc.c >> 8, byte.c) FROM crc JOIN byte ON byte.b = xor(crc.c & 255, ascii(s[i + 1])::BIGINT) WHERE i < length(s)
), h AS (
  SELECT doc_id, xor(c, 4294967295) AS h FROM crc WHERE i = length(s)
), t AS (
  SELECT row_number() OVER () AS r, d.doc_id, h, h // 10 AS g, regexp_extract_all(coalesce(text, ''), '[^ 	-]+') AS w FROM documents d LEFT JOIN h ON d.doc_id = h.doc_id
), a AS (
  SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN g % len(w) END AS a FROM t
), w AS (
  SELECT r, doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) END AS w FROM a
), p AS (
  SELECT r, n, unnest(range(n)) AS i, unnest(w) AS word FROM w
), f AS (
  SELECT * FROM p QUALIFY count(*) OVER (PARTITION BY r, word) >= 4
), e AS (
  SELECT x.r, x.i, y.i - x.i AS q FROM f x JOIN f y ON x.r = y.r AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n
), s AS (
  SELECT r, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM e) GROUP BY r, q, island HAVING count(*) + q >= greatest(6, 4 * q)
), u AS (
  SELECT r, start, length, min(q)::BIGINT AS period FROM s GROUP BY r, start, length
), o AS (
  SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs FROM u GROUP BY r
), best AS (
  SELECT r, start, length, period FROM u QUALIFY row_number() OVER (PARTITION BY r ORDER BY length::DOUBLE / period DESC, start, period) = 1
), gone AS (
  SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM u
), c AS (
  SELECT r, string_agg(word, ' ' ORDER BY i) AS collapsed FROM p ANTI JOIN gone USING (r, i) GROUP BY r
)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period, (length * 1000 // period)::BIGINT AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM w LEFT JOIN o USING (r) LEFT JOIN best USING (r) LEFT JOIN c USING (r)
"""
