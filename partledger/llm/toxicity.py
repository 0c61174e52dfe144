"""Operator 9: toxicity by nearest labelled examples, with exact TF-IDF cosine over a block-max inverted index."""

from __future__ import annotations

import math
from binascii import crc32
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from partledger.llm.common import TEXTS_AT_ONCE, table, written

#: Labelled examples of each label at most: the bound of what the index holds.
EXAMPLES = 2000
#: Neighbours that vote, and examples in a block of the index. A term of more than one in COMMON examples is a row of weights.
NEIGHBOURS, BLOCK, COMMON = 15, 64, 16
#: Texts whose common terms are multiplied out at once.
TOGETHER = 256
#: Cells in which the documents of words that no example has are counted, by a hash of the word: a power of two. Words of one cell share
#: its count, so with far more words than cells their idf comes out low; their tf stays each one's own.
CELLS = 1 << 22
#: A term counts (FLOOR * HALF + x) / (HALF + x) of its idf, where x is the chi-square of its presence against the label.
HALF, FLOOR = 10.0, 0.05

EVIDENCE = "array<struct<id: bigint, cosine: double, label: int>>"
#: Bytes of UTF-8 text: A-Z in lower case, digits, letters and all beyond ASCII stay, the rest parts words.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


def numbered(text: str | None, numbers: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The numbers of a text's terms, rising, and how often each stands in it; then the cell of each word without a number, and how often
    that word does."""
    words = words_of(text)
    codes = np.fromiter(map(numbers.get, words, repeat(-1)), np.int32, len(words))
    terms, counts = np.unique(codes[codes >= 0], return_counts=True)
    others = Counter([words[i] for i in np.flatnonzero(codes < 0).tolist()])
    cells = np.fromiter((crc32(w) & (CELLS - 1) for w in others), np.int32, len(others))
    return terms, counts, cells, np.fromiter(others.values(), np.int32, len(others))


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after another."""
    return np.arange(sizes.sum()) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)


@dataclass
class BlockMaxIndex:
    """Unit vectors of the examples by term. A term of many examples has a row of weights; any other has, for each block of
    examples with it, the largest weight and the postings."""

    term_weights: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    rows: np.ndarray  # by term: its row in dense, or -1
    dense: np.ndarray
    term_starts: np.ndarray  # where each term's entries begin
    blocks: np.ndarray  # by entry, like the next two
    most: np.ndarray
    entry_starts: np.ndarray
    places: np.ndarray  # by posting, like the next one
    weights: np.ndarray

    @classmethod
    def build(cls, term_weights: np.ndarray, examples: Sequence[tuple[int, int, np.ndarray, np.ndarray]]) -> BlockMaxIndex:
        """From (id, label, terms, counts). Examples with the same heaviest term stand together, so that few blocks have a high bound."""
        held = [(i, y, t, unit(term_weights, t, c)) for i, y, t, c in examples if len(t)]
        held.sort(key=lambda v: (int(v[2][np.argmax(v[3])]), v[0]))
        size = [len(t) for _, _, t, _ in held]
        terms = np.concatenate([t for _, _, t, _ in held] or [np.zeros(0, np.int32)])
        weights = np.concatenate([w for _, _, _, w in held] or [np.zeros(0)])
        places = np.repeat(np.arange(len(held)), size)
        common = np.flatnonzero(np.bincount(terms, minlength=len(term_weights)) * COMMON > len(held))
        rows = np.full(len(term_weights), -1, np.int32)
        rows[common] = np.arange(len(common))
        dense = np.zeros((len(common), len(held)))
        in_row = rows[terms] >= 0
        dense[rows[terms[in_row]], places[in_row]] = weights[in_row]
        terms, weights, places = terms[~in_row], weights[~in_row], places[~in_row]
        order = np.lexsort((places, terms))
        terms, weights, places = terms[order], weights[order], places[order]
        first = np.flatnonzero(np.diff(terms, prepend=-1) | np.diff(places // BLOCK, prepend=-1))
        most = np.maximum.reduceat(weights, first) if len(first) else np.zeros(0)
        starts = np.searchsorted(terms[first], np.arange(len(term_weights) + 1))
        ids, labels = np.array([v[0] for v in held], np.int64), np.array([v[1] for v in held], np.int8)
        return cls(term_weights, ids, labels, rows, dense, starts, (places // BLOCK)[first].astype(np.int32), most, np.append(first, len(terms)), places.astype(np.int32), weights)

    def common_parts(self, vectors: Sequence[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """What the common terms add to the cosines of several texts, given (terms, unit weights), with all examples."""
        queries = np.zeros((len(vectors), len(self.dense)))
        for k, (terms, values) in enumerate(vectors):
            row = self.rows[terms]
            queries[k, row[row >= 0]] = values[row >= 0]
        return queries @ self.dense

    def nearest(self, terms: np.ndarray, values: np.ndarray, part: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k largest cosines above 0 and the places of their examples, given a text's terms, unit weights and common part.

        No cosine is below its common part, so the k-th largest of those is a floor; postings are read only in blocks that can hold
        a cosine at the floor or above it. Of equal cosines the smaller id comes first.
        """
        if not len(terms) or not len(self.ids):
            return np.zeros(0), np.zeros(0, np.int64)
        part = part.copy()
        if without >= 0:
            part[without] = 0
        rare = self.rows[terms] < 0
        terms, values = terms[rare], values[rare]
        n = self.term_starts[terms + 1] - self.term_starts[terms]
        entries, value = ranges(self.term_starts[terms], n), np.repeat(values, n)
        of_block, starts = self.blocks[entries], np.arange(0, len(self.ids), BLOCK)
        bounds = np.maximum.reduceat(part, starts) + np.bincount(of_block, value * self.most[entries], minlength=len(starts))
        floor = np.partition(part, -k)[-k] if len(part) > k else 0.0
        chosen = bounds >= floor - 1e-9
        mine = chosen[of_block]
        e = entries[mine]
        m = self.entry_starts[e + 1] - self.entry_starts[e]
        p = ranges(self.entry_starts[e], m)
        sums = np.round(part + np.bincount(self.places[p], np.repeat(value[mine], m) * self.weights[p], minlength=len(part)), 12)
        if without >= 0:
            sums[without] = 0
        able = np.flatnonzero((sums > 0) & np.repeat(chosen, BLOCK)[: len(sums)])
        if len(able) > k:
            able = able[sums[able] >= np.partition(sums[able], -k)[-k]]
        best = able[np.lexsort((self.ids[able], -sums[able]))[:k]]
        return sums[best], best

    def vote(self, cosines: np.ndarray, found: np.ndarray) -> float:
        """Votes weighted by the inverse of the distance 1 - cosine."""
        weights = 1 / (1.05 - np.minimum(1.0, cosines))
        return float((weights * self.labels[found]).sum() / weights.sum())


def unit(term_weights: np.ndarray, terms: np.ndarray, counts: np.ndarray, beyond: float = 0.0) -> np.ndarray:
    """The weights of a text's terms over its norm; beyond is the sum of the squares of the weights of its other words."""
    values = (1 + np.log(counts)) * term_weights[terms]
    return values / math.sqrt(float(values @ values) + beyond) if len(values) else values


@dataclass
class Scorer:
    index: BlockMaxIndex
    cells: np.ndarray  # the weight of a word that no example has, by its cell
    slope: float
    offset: float
    without_neighbours: float

    def scores(self, texts: Sequence[tuple[np.ndarray, ...]]) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
        """The score, the nearest cosines and their places for each of a few texts, given as numbered gives them."""
        vectors = [(t, unit(self.index.term_weights, t, c, float((((1 + np.log(times)) * self.cells[cells]) ** 2).sum()))) for t, c, cells, times in texts]
        for (terms, values), part in zip(vectors, self.index.common_parts(vectors), strict=True):
            cosines, found = self.index.nearest(terms, values, part, NEIGHBOURS)
            if not len(found):
                yield self.without_neighbours, cosines, found
            else:
                yield 1 / (1 + math.exp(-(self.slope * self.index.vote(cosines, found) + self.offset))), cosines, found


def calibrated(votes: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve from votes to labels, by Newton steps with a light ridge."""
    x = np.stack([votes, np.ones_like(votes)], axis=1)
    b = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-(x @ b)))
        gradient = x.T @ (weights * (labels - p)) - 0.1 * b
        hessian = (x * (weights * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2)
        b = b + np.clip(np.linalg.solve(hessian, gradient), -2, 2)
    return float(b[0]), float(b[1])


@dataclass
class Examples:
    """The labelled sample: its rows (id, label, terms, counts), the words by number, and how many rows each label has in all."""

    rows: list[tuple[int, int, np.ndarray, np.ndarray]]
    numbers: dict[bytes, int]
    labelled: dict[int, int]


def examples_of(docs: DataFrame, labels: DataFrame, text: str, doc_id: str, label: str, examples: int) -> Examples | None:
    """Up to `examples` rows of each label, those with the least hashes of their ids; None without rows of both labels."""
    given = labels.select(F.col(doc_id).cast("long").alias("id"), F.col(label).cast("int").alias("label"))
    given = written(given.filter("id is not null and label in (0, 1)").groupBy("id").agg(F.max("label").alias("label")), "labels")
    labelled = {r[0]: r[1] for r in given.groupBy("label").count().collect()}
    if len(labelled) < 2:
        return None
    chosen = [given.filter(F.col("label") == y).orderBy(F.xxhash64("id"), "id").limit(examples) for y in (0, 1)]
    chosen = written(chosen[0].unionByName(chosen[1]), "chosen")  # 2 * examples rows at most
    texts = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text")).join(F.broadcast(chosen), "id")
    texts = texts.groupBy("id", "label").agg(F.min("text").alias("text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            found = [Counter(words_of(t.as_py())) for t in part.column("text")]
            columns = [pa.array([list(c) for c in found], pa.list_(pa.binary())), pa.array([list(c.values()) for c in found], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("label"), *columns], ["id", "label", "words", "counts"])

    sample = texts.mapInArrow(counted, "id long, label int, words array<binary>, counts array<int>").orderBy("id").toArrow()
    ids, ys = sample.column("id").to_numpy(), sample.column("label").to_numpy()
    if len(set(ys.tolist())) < 2:
        return None
    lists = sample.column("words").combine_chunks()
    coded = pa.chunked_array([lists.flatten()]).dictionary_encode().combine_chunks()
    codes = coded.indices.to_numpy().astype(np.int32)
    counts = sample.column("counts").combine_chunks().flatten().to_numpy()
    ends = np.cumsum(lists.value_lengths().to_numpy())
    rows = []
    for i, y, t, c in zip(ids, ys, np.split(codes, ends[:-1]), np.split(counts, ends[:-1]), strict=True):
        order = np.argsort(t)
        rows.append((int(i), int(y), t[order], c[order]))
    return Examples(rows, {w: k for k, w in enumerate(coded.dictionary.to_pylist())}, labelled)


VECTOR = ["_terms", "_counts", "_cells", "_times"]


def term_vectors(docs: DataFrame, numbers: dict[bytes, int], text: str, keep: Sequence[str]) -> DataFrame:
    """The columns in keep with _terms, _counts, _cells and _times (as numbered), written: whole texts are split into words once."""
    sent = docs.sparkSession.sparkContext.broadcast(numbers)
    # The text goes to Python once, also where it is kept.
    own = text in keep and docs.schema[text].dataType == T.StringType()
    kept = docs.select(*keep) if own else docs.select(*keep, F.col(text).cast("string").alias("_text"))
    names, words = list(keep), text if own else "_text"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for at in range(0, part.num_rows, 1024):
                few = part.slice(at, 1024)
                found = [numbered(t.as_py(), sent.value) for t in few.column(words)]
                lists = []
                for k in range(4):
                    ends = pa.array(np.concatenate([[0], np.cumsum([len(f[k]) for f in found])]).astype(np.int32))
                    lists.append(pa.ListArray.from_arrays(ends, pa.array(np.concatenate([f[k] for f in found]).astype(np.int32))))
                yield pa.RecordBatch.from_arrays([*few.columns[: len(names)], *lists], [*names, *VECTOR])

    numbers_of = T.ArrayType(T.IntegerType())
    return written(kept.mapInArrow(each, T.StructType([*kept.schema.fields[: len(names)], *(T.StructField(c, numbers_of) for c in VECTOR)])), "vectors", TEXTS_AT_ONCE)


def fit(sample: Examples, vectors: DataFrame) -> Scorer:
    """A scorer from the examples and the vectors of all documents, over which document frequencies are counted."""
    total, size = vectors.count(), len(sample.numbers)

    def frequencies(column: str, size: int) -> np.ndarray:
        counted = vectors.select(F.explode(column).alias("term")).groupBy("term").agg(F.count("*").alias("n")).toArrow()
        out = np.zeros(size)
        out[counted.column("term").to_numpy()] = counted.column("n").to_numpy()
        return out

    frequency = frequencies("_terms", size)
    idf = lambda f: np.log((1 + total) / (1 + f)) + 1
    cells = (FLOOR * idf(np.minimum(frequencies("_cells", CELLS), total))).astype(np.float32)
    with_label = np.zeros((2, size))
    for _, y, terms, _ in sample.rows:
        with_label[y, terms] += 1
    n = [sum(y == k for _, y, _, _ in sample.rows) for k in (0, 1)]
    b, a = with_label
    apart = np.maximum(0, np.abs(a * (n[0] - b) - b * (n[1] - a)) - (n[0] + n[1]) / 2)
    chi2 = np.where(a + b > 0, (n[0] + n[1]) * apart**2 / (1.0 * n[0] * n[1] * np.maximum(a + b, 1) * (n[0] + n[1] - a - b + 0.5)), 0)
    weights = idf(frequency) * (FLOOR * HALF + chi2) / (HALF + chi2)
    index = BlockMaxIndex.build(weights, sample.rows)

    # Calibration: each example is scored by the others; weights undo the sampling by label.
    stands_for = {y: sample.labelled[y] / n[y] for y in (0, 1)}
    place = {int(i): k for k, i in enumerate(index.ids)}
    votes, ys, ws, bare = [], [], [], [0.0, 0.0]
    for at in range(0, len(sample.rows), TOGETHER):
        few = sample.rows[at : at + TOGETHER]
        vectors_of = [(t, unit(weights, t, c)) for _, _, t, c in few]
        for (i, y, _, _), (terms, values), part in zip(few, vectors_of, index.common_parts(vectors_of), strict=True):
            near = index.nearest(terms, values, part, NEIGHBOURS, without=place.get(i, -1))
            if len(near[1]):
                votes.append(index.vote(*near))
                ys.append(y)
                ws.append(stands_for[y])
            else:
                bare[y] += stands_for[y]
    slope, offset = calibrated(np.array(votes), np.array(ys, float), np.array(ws) / max(stands_for.values())) if votes else (0.0, 0.0)
    return Scorer(index, cells, slope, offset, (bare[1] + 0.5 * sample.labelled[1] / sum(sample.labelled.values())) / (bare[0] + bare[1] + 1))


def score_vectors(vectors: DataFrame, scorer: Scorer) -> DataFrame:
    """vectors with score, predicted and evidence in place of the terms; nothing is shuffled, and only the terms go to Python."""
    sent = vectors.sparkSession.sparkContext.broadcast(scorer)
    names = [c for c in vectors.columns if c not in VECTOR]

    def each(terms: pa.Array, counts: pa.Array, cells: pa.Array, times: pa.Array) -> pa.Array:
        model, lists = sent.value, (terms, counts, cells, times)
        scores, cosines, places = [], [], []
        for start in range(0, len(terms), TOGETHER):
            few = [tuple(x.values.to_numpy() for x in row) for row in zip(*(c.slice(start, TOGETHER) for c in lists), strict=True)]
            for s, cos, at in model.scores(few):
                scores.append(s)
                cosines.append(cos[:3])
                places.append(at[:3])
        at = np.concatenate([*places, np.zeros(0, np.int64)]).astype(np.int64)
        ends = pa.array(np.concatenate([[0], np.cumsum([len(p) for p in places])]).astype(np.int32))
        values = [pa.array(model.index.ids[at]), pa.array(np.concatenate([*cosines, np.zeros(0)])), pa.array(model.index.labels[at].astype(np.int32))]
        evidence = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(values, ["id", "cosine", "label"]))
        columns = [pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), evidence]
        return pa.StructArray.from_arrays(columns, ["score", "predicted", "evidence"])

    # Else a filter over the scores would be pushed below them, and score each row twice.
    scored = F.arrow_udf(each, f"score double, predicted int, evidence {EVIDENCE}").asNondeterministic()
    return vectors.withColumn("_scored", scored(*VECTOR)).select(*names, "_scored.score", "_scored.predicted", "_scored.evidence")


def score_toxicity(docs: DataFrame, labels: DataFrame, *, keep: Sequence[str] | None = None, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", examples: int = EXAMPLES) -> DataFrame:
    """The columns of docs named in keep (all, unless said otherwise) with score, predicted and evidence (the three nearest
    examples: id, cosine, label).

    Terms are the words of the labelled examples. Every other word of a text counts in its norm by its own tf and by its idf, from
    counts in CELLS cells. Weights are (1 + log tf) * idf * relevance: idf over all documents, relevance from the examples' labels,
    never 0, so no term is left out; words that no example has have the least. Examples are a bounded sample (up to `examples` of each label; an id with two labels counts as 1, one with
    several texts as the least of them). The nearest are exact; of equally near ones those with the smaller ids count.

    A text without a word of any example (so also a null or empty one) gets the share of 1 among such examples; without
    examples of both labels every score is 0. Whole texts are read, however long, one row at a time. Repeated rows get equal
    scores each; null ids are scored like others and are no examples; an empty table gives an empty result. Columns of
    docs that clash with the new ones are replaced.
    """
    new = ("score", "predicted", "evidence", "_text", "_scored", *VECTOR)
    keep = [c for c in (keep or docs.columns) if c not in new]
    sample = examples_of(docs, labels, text, doc_id, label, examples)
    if sample is None:
        return docs.select(*keep).withColumns({"score": F.lit(0.0), "predicted": F.lit(0), "evidence": F.array().cast(EVIDENCE)})
    vectors = term_vectors(docs, sample.numbers, text, keep)
    return score_vectors(vectors, fit(sample, vectors))


def held_out(doc_id: str = "doc_id"):
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def op9_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score_toxicity(docs, labels.filter(~held_out()), keep=["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted", "evidence")
