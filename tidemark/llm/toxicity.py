"""Toxicity: a factorization machine over hashed terms of the whole text.

The linear part weighs single terms; the pairwise part sees two terms together, such as an insult next to
a group mention, that are harmless apart.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.frames import blank, materialize, packed, slices, unused

WORD = re.compile(r"[^\W\d_]+")
CACHED_WORDS = 120_000


@dataclass(frozen=True)
class Settings:
    """sample: labelled rows to learn from at most, the smallest by hash of the id. buckets: of the hash.
    terms: hashed terms kept, those that tell the classes apart best; significance: chi-square they need."""

    sample: int = 20_000
    buckets: int = 1 << 22
    terms: int = 4096
    significance: float = 12.0
    rank: int = 8
    steps: int = 1100
    batch: int = 256
    rate: float = 0.03
    decay: float = 2e-4
    stems: tuple[int, ...] = (4, 6)
    often: int = 3


def bucket(term: str, buckets: int) -> int:
    return zlib.crc32(term.encode()) % buckets


def word_terms(word: str, s: Settings) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """Buckets of a word and its stems, and of the stems once they occur `often`."""
    stems = [word[:n] for n in s.stems if len(word) > n]
    return (bucket(word, s.buckets), *(bucket(f"{p}~", s.buckets) for p in stems)), tuple(bucket(f"{p}~~", s.buckets) for p in stems)


class Terms:
    """Hashed terms of texts; only those of `index` if given, as their places in it."""

    def __init__(self, s: Settings, index: dict[int, int] | None = None):
        self.s, self.index, self.cache = s, index, {}

    def of_word(self, word: str) -> tuple[tuple[int, ...], tuple[int, ...]]:
        found = self.cache.get(word)
        if found is None:
            found = word_terms(word, self.s)
            if self.index is not None:
                found = tuple(tuple(self.index[b] for b in part if b in self.index) for part in found)
            if len(self.cache) < CACHED_WORDS:
                self.cache[word] = found
        return found

    def of_text(self, text: str) -> list[int]:
        present: set[int] = set()
        often: Counter[int] = Counter()
        for word, n in Counter(WORD.findall(text.lower())).items():
            single, stems = self.of_word(word)
            if single:
                present.update(single)
            for b in stems:
                often[b] += n
        present.update(b for b, n in often.items() if n >= self.s.often)
        return sorted(present)


@dataclass
class Machine:
    """score = sigmoid(bias + sum of w + sum of v_i . v_j over pairs), on the terms of a text."""

    bias: float
    w: np.ndarray
    v: np.ndarray

    def scores(self, lists: list[list[int]]) -> np.ndarray:
        return _sigmoid(_forward(self.bias, self.w, self.v, *_flat(lists))[0])


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(x) for x in lists], np.int64)
    flat = np.fromiter((i for x in lists for i in x), np.int64, int(sizes.sum()))
    return flat, sizes


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _forward(bias: float, w: np.ndarray, v: np.ndarray, flat: np.ndarray, sizes: np.ndarray):
    """Margins, sums of factors per text, and the text of each term. The pair part is averaged over the
    terms, so that it does not grow with the square of a text's length."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    linear = np.bincount(row, w[flat], len(sizes))
    sums = np.zeros((len(sizes), v.shape[1]))
    factors = v[flat]
    for k in range(v.shape[1]):
        sums[:, k] = np.bincount(row, factors[:, k], len(sizes))
    squares = np.bincount(row, (factors**2).sum(1), len(sizes))
    scale = 1 / np.sqrt(np.maximum(sizes, 1))
    return bias + linear + 0.5 * scale * ((sums**2).sum(1) - squares), sums, row, scale


def fit(lists: list[list[int]], labels: list[int], terms: int, s: Settings, seed: int = 7) -> Machine:
    """Adam on the logistic loss in minibatches. With one class only, the smoothed prior everywhere."""
    y = np.array(labels, np.float64)
    prior = (y.sum() + 1) / (len(y) + 2)
    w, v = np.zeros(terms), np.zeros((terms, s.rank))
    bias = math.log(prior / (1 - prior))
    if not terms or len(set(labels)) < 2:
        return Machine(bias, w, v)
    rng = np.random.default_rng(seed)
    v = rng.normal(0, 0.05, (terms, s.rank))
    mw, sw, mv, sv, mb, sb = np.zeros_like(w), np.zeros_like(w), np.zeros_like(v), np.zeros_like(v), 0.0, 0.0
    step = 0
    while step < s.steps:
        rate = s.rate * (1 - step / s.steps)
        order = rng.permutation(len(y))
        for at in range(0, len(y), s.batch):
            part = order[at : at + s.batch]
            flat, sizes = _flat([lists[i] for i in part])
            z, sums, row, scale = _forward(bias, w, v, flat, sizes)
            g = (_sigmoid(z) - y[part]) / len(part)
            gw = np.bincount(flat, g[row], terms) + s.decay * w
            gv = s.decay * v
            pull = (g * scale)[row, None] * (sums[row] - v[flat])
            for k in range(s.rank):
                gv[:, k] += np.bincount(flat, pull[:, k], terms)
            gb = g.sum()
            step += 1
            mw, sw = 0.9 * mw + 0.1 * gw, 0.99 * sw + 0.01 * gw**2
            mv, sv = 0.9 * mv + 0.1 * gv, 0.99 * sv + 0.01 * gv**2
            mb, sb = 0.9 * mb + 0.1 * gb, 0.99 * sb + 0.01 * gb**2
            a, b = 1 - 0.9**step, 1 - 0.99**step
            w = w - rate * (mw / a) / (np.sqrt(sw / b) + 1e-8)
            v = v - rate * (mv / a) / (np.sqrt(sv / b) + 1e-8)
            bias -= rate * (mb / a) / (math.sqrt(sb / b) + 1e-8)
    return Machine(bias, w, v)


def held_out(doc_id: str | Column) -> Column:
    """The fold that is never learned from: CRC-32 of the id as text, modulo 5, is 0."""
    column = F.col(f"`{doc_id}`") if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", s: Settings = Settings()) -> tuple[dict[int, int], Machine]:
    """(place of each kept term, machine), from at most `s.sample` labelled rows outside the held-out fold.

    The sample's size bounds what is broadcast (ids and labels) and, with `s.terms`, what reaches the driver;
    class counts per term are aggregated on the cluster. Rows that repeat id, text and label are one; where an id
    has several texts and the rows are more than the sample, those with the smallest hashes of both stay.
    """
    known = packed(labels, doc_id, label).filter(F.col(f"`{label}`").isNotNull() & F.col(f"`{doc_id}`").isNotNull() & ~held_out(doc_id))
    known = known.select(F.col(f"`{doc_id}`").alias("doc_id"), (F.col(f"`{label}`") > 0).cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(s.sample)
    texts = packed(docs, doc_id, text).select(F.col(f"`{doc_id}`").alias("doc_id"), blank(text).alias("text")).join(F.broadcast(chosen), "doc_id").select("y", "text", F.xxhash64("doc_id", "text").alias("h"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(s)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                lists = [terms.of_text(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lists, pa.list_(pa.int32())), part.column(2)], names=["y", "terms", "h"])

    rows = texts.mapInArrow(hashed, "y int, terms array<int>, h long").groupBy("h", "y").agg(F.first("terms").alias("terms"))
    sample = materialize(rows, "toxic-sample")
    classes = F.count("*"), F.coalesce(F.sum("y"), F.lit(0))
    total, positive = sample.agg(*classes).first()
    if total > s.sample:
        last = sample.select("h", "y").orderBy("h", "y").limit(s.sample).agg(F.max(F.struct("h", "y")).alias("last")).first().last
        sample = sample.filter((F.col("h") < last.h) | ((F.col("h") == last.h) & (F.col("y") <= last.y)))
        total, positive = sample.agg(*classes).first()
    if not total:
        return {}, fit([], [], 0, s)
    counts = sample.select("y", F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n"), F.sum("y").alias("p"))
    n, p, of, neg = F.col("n"), F.col("p"), F.lit(float(total)), F.lit(float(total - positive))
    cross = p * (neg - (n - p)) - (n - p) * (F.lit(float(positive)) - p)
    chi = of * cross * cross / (n * (of - n) * F.lit(float(positive)) * neg)
    best = counts.filter(n >= 3).select("term", chi.alias("chi")).filter(F.col("chi") >= s.significance).orderBy(F.desc("chi"), "term").limit(s.terms)
    index = {row.term: k for k, row in enumerate(best.collect())}
    wanted = docs.sparkSession.sparkContext.broadcast(index)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = wanted.value.get
        for batch in batches:
            lists = [[i for t in x if (i := get(t)) is not None] for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.list_(pa.int32()))], names=["y", "terms"])

    rows = sample.select("y", "terms").mapInArrow(mapped, "y int, terms array<int>").collect()
    rows.sort(key=lambda r: (r.y, list(r.terms)))
    return index, fit([list(r.terms) for r in rows], [r.y for r in rows], len(index), s)


def score_texts(docs: DataFrame, index: dict[int, int], machine: Machine, text: str = "text", into: str = "score", s: Settings = Settings()) -> DataFrame:
    """All columns of `docs` and `into`, the score of the whole text; null texts score as empty ones, by the bias."""
    shared = docs.sparkSession.sparkContext.broadcast((index, machine))
    body, columns = unused(docs.columns, "_body"), [F.col(f"`{c}`") for c in docs.columns]

    width = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, model = shared.value
        terms = Terms(s, places)
        for part in slices(batches, width, 500):
            scores = model.scores([terms.of_text(t) for t in part.column(width).to_pylist()])
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(scores)], names=[*part.schema.names[:-1], into])

    return docs.select(*columns, blank(text).alias(body)).mapInArrow(run, T.StructType([*docs.schema, T.StructField(into, T.DoubleType())]))


def score_toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", s: Settings = Settings()) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, score (0 to 1), predicted (score >= 0.5).

    Only the text decides the score. Without usable labels every score is 0.5, with one class the smoothed
    prior. Null ids are outside the held-out fold; equal texts score alike; an empty table gives no rows.
    """
    index, machine = learn(docs, labels, doc_id, text, label, s)
    scored = score_texts(packed(docs, doc_id, text), index, machine, text, "score", s)
    return scored.select(f"`{doc_id}`", held_out(doc_id).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", s: Settings = Settings()) -> DataFrame:
    """The rows of `docs` whose score is below 0.5, with all columns."""
    index, machine = learn(docs, labels, doc_id, text, label, s)
    score = unused(docs.columns, "_score")
    return score_texts(docs, index, machine, text, score, s).filter(F.col(score) < 0.5).drop(score)
