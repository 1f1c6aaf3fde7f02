"""Language identification by nearest centroids of TF-IDF letter n-grams.

A text is a normalised vector of weighted n-grams of letters; each language has several centroids, the clusters of its
own training vectors, and the text takes the language of the centroid with the largest cosine. A text too far from its
centroid, compared with the texts the centroid was made of, is marked as rejected.
"""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.frames import blank, keep, materialize, packed, slices

BLOCK = 1 << 20  # characters counted at once; a longer text is counted in blocks, each as a text of its own
UNDETERMINED = "und"


@dataclass(frozen=True)
class Settings:
    """per_language: labelled documents a language is learned from at most, the smallest by hash of id and text.
    orders: lengths of the n-grams; buckets: of the hash, per order; terms: n-grams kept, those with the largest share
    of documents in some language. centroids: clusters per language at most; members: documents a cluster needs on
    average. slack: standard deviations below the mean cosine of a cluster's members at which a text is rejected."""

    per_language: int = 1000
    orders: int = 3
    buckets: int = 1 << 16
    terms: int = 4096
    centroids: int = 6
    members: int = 20
    rounds: int = 12
    slack: float = 7.0


@functools.cache
def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def ngrams(texts: list[str], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every n-gram of 1 to `orders` characters, lower-cased; what is not a letter is one blank
    between words, and an n-gram holds one letter at least."""
    parts, owner = [], []
    for k, text in enumerate(texts):
        low = text.lower()
        for at in range(0, len(low), BLOCK):
            parts.append(f" {low[at : at + BLOCK]} ")
            owner.append(k)
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(p) for p in parts])
    part, first = np.repeat(np.arange(len(parts)), sizes), np.zeros(len(codes), bool)
    first[np.cumsum(sizes) - sizes] = True
    letter = letters()[codes]
    stays = letter | first
    stays[1:] |= letter[:-1]
    codes, part = np.where(letter, codes, 32)[stays].astype(np.uint64), part[stays]
    found, value, some = [], np.zeros(len(codes), np.uint64), np.zeros(len(codes), bool)
    with np.errstate(over="ignore"):
        for n in range(s.orders):
            stop = len(codes) - n
            if stop <= 0:
                break
            value = value[:stop] * np.uint64(0x100000001B3) + codes[n:]
            some = some[:stop] | (codes[n:] != 32)
            ok = some & (part[:stop] == part[n:])
            bucket = (value[ok] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(s.buckets)
            found.append((part[:stop][ok], bucket.astype(np.int64) + n * s.buckets))
    place, bucket = (np.concatenate(x) for x in zip(*found))
    return np.array(owner)[place], bucket


def weigh(place: np.ndarray, term: np.ndarray, rows: int, idf: np.ndarray) -> np.ndarray:
    """Normalised rows of (1 + log count) * idf over the kept terms; a text without any is zero."""
    count = np.bincount(place * len(idf) + term, minlength=rows * len(idf)).reshape(rows, len(idf)).astype(np.float32)
    return unit(np.where(count > 0, 1 + np.log(np.maximum(count, 1)), 0) * idf)


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return (x / np.where(norm > 0, norm, 1)).astype(np.float32)


def cluster(x: np.ndarray, count: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(centroids, cluster of each row): spherical k-means, begun with rows far from those chosen before. Rows come in a
    defined order, ties go to the first, and a cluster that loses all rows goes, so that the result repeats."""
    chosen = unit(x.mean(0, keepdims=True))
    near = x @ chosen[0]
    for _ in range(count - 1):
        chosen = np.vstack([chosen, x[np.argmin(near)]])
        near = np.maximum(near, x @ chosen[-1])
    for _ in range(rounds):
        of = np.argmax(x @ chosen.T, axis=1)
        held, of = np.unique(of, return_inverse=True)
        chosen = unit(np.stack([x[of == k].sum(0) for k in range(len(held))]))
    return chosen, np.argmax(x @ chosen.T, axis=1)


@dataclass
class Model:
    """Centroids in the order of language and number, the cosine below which each rejects, and the kept terms."""

    languages: list[str]
    centroids: np.ndarray
    floors: np.ndarray
    place: np.ndarray
    idf: np.ndarray
    usual: str

    def vectors(self, texts: list[str], s: Settings) -> np.ndarray:
        row, bucket = ngrams(texts, s)
        term = self.place[bucket]
        return weigh(row[term >= 0], term[term >= 0], len(texts), self.idf)

    def identify(self, texts: list[str], s: Settings) -> list[tuple[str, float, bool]]:
        """(language, cosine, rejected) of texts; one with no known n-gram takes the usual language and is rejected."""
        cosines = self.vectors(texts, s) @ self.centroids.T
        best = np.argmax(cosines, axis=1)
        top = np.clip(cosines[np.arange(len(texts)), best], 0, 1)
        return [(self.languages[b] if c > 0 else self.usual, float(c), bool(c <= 0 or c < self.floors[b])) for b, c in zip(best.tolist(), top)]


def held_out(doc_id: str | Column) -> Column:
    """The fold that is never learned from: CRC-32 of the id as text (null: empty), modulo 3, is 1."""
    column = F.col(f"`{doc_id}`") if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def learn(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", s: Settings = Settings()) -> Model | None:
    """The model, from the labelled documents outside the held-out fold; None if there are none.

    Per language at most `s.per_language` documents, so that the broadcast sample ids, the clustering of a language in one
    task and the model (terms x centroids x languages floats) are bounded by the number of languages. Repeated rows are
    one document. N-grams are counted and chosen on the cluster; the texts of the sample are read where they lie.
    """
    spark = docs.sparkSession
    rows = packed(docs, doc_id, text, lang).filter(F.col(f"`{lang}`").isNotNull() & ~held_out(doc_id) & has_letter(F.col(f"`{text}`")))
    rows = rows.select(F.col(f"`{lang}`").alias("lang"), blank(text).alias("text"), F.xxhash64(F.col(f"`{doc_id}`"), F.col(f"`{text}`")).alias("h"))
    ids = rows.select("lang", "h").distinct()
    chosen = materialize(ids.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).filter(F.col("r") <= s.per_language).drop("r"), "lang-sample")
    texts = rows.join(F.broadcast(chosen), ["lang", "h"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1, 200):
            row, bucket = ngrams(part.column(1).to_pylist(), s)
            key, n = np.unique(row * (s.orders * s.buckets) + bucket, return_counts=True)
            stops = np.searchsorted(key, np.arange(part.num_rows + 1) * (s.orders * s.buckets)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(stops), pa.array(x.astype(np.int32))) for x in (key % (s.orders * s.buckets), n)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *lists], names=["lang", "h", "buckets", "counts"])

    sample = texts.select("lang", "text", "h").mapInArrow(counted, "lang string, h long, buckets array<int>, counts array<int>")
    sample = keep(sample.groupBy("lang", "h").agg(F.first("buckets").alias("buckets"), F.first("counts").alias("counts")), "lang-ngrams")
    sizes = {r.lang: r.n for r in sample.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    total = sum(sizes.values())
    size = spark.createDataFrame(list(sizes.items()), "lang string, size long")
    df = sample.select("lang", F.explode("buckets").alias("bucket")).groupBy("lang", "bucket").agg(F.count("*").alias("n"))
    df = df.join(F.broadcast(size), "lang").groupBy("bucket").agg(F.sum("n").alias("n"), F.max(F.col("n") / F.col("size")).alias("share"))
    best = df.orderBy(F.desc("share"), "bucket").limit(s.terms).collect()
    place = np.full(s.orders * s.buckets, -1, np.int32)
    place[[r.bucket for r in best]] = np.arange(len(best))
    idf = (np.log((1 + total) / (1 + np.array([r.n for r in best]))) + 1).astype(np.float32)
    shared = spark.sparkContext.broadcast((place, idf))

    def clustered(group: pd.DataFrame) -> pd.DataFrame:
        place, idf = shared.value
        group = group.sort_values("h", kind="stable")
        x = np.zeros((len(group), len(idf)), np.float32)
        for k, (bucket, n) in enumerate(zip(group["buckets"], group["counts"])):
            term = place[bucket]
            np.add.at(x[k], term[term >= 0], n[term >= 0])
        x = unit(np.where(x > 0, 1 + np.log(np.maximum(x, 1)), 0) * idf)
        centroids, of = cluster(x, max(1, min(s.centroids, len(x) // s.members)), s.rounds)
        near = np.array([(x[of == k] @ c).mean() - s.slack * (x[of == k] @ c).std() if (of == k).any() else 0 for k, c in enumerate(centroids)])
        return pd.DataFrame({"lang": group["lang"].iloc[0], "number": np.arange(len(centroids)), "floor": np.maximum(near, 0), "centroid": list(centroids)})

    made = sample.groupBy("lang").applyInPandas(clustered, "lang string, number int, floor double, centroid array<float>").orderBy("lang", "number").collect()
    return Model(
        [r.lang for r in made], np.array([r.centroid for r in made], np.float32), np.array([r.floor for r in made]), place, idf,
        min(sizes, key=lambda name: (-sizes[name], name)),
    )


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def identify_languages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", s: Settings = Settings()) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, lang_pred, score (cosine with the nearest centroid) and rejected.

    Only the whole text decides. A text that is null or without a letter is `und` with score 0 and rejected; without any
    learned language all are. Of equally near centroids the first by language and number counts. Labels may be wrong or
    missing for any document; equal texts get equal rows, repeated rows stay rows, a null id is in the fold of the
    empty text, texts over BLOCK characters are counted in blocks, extra columns are ignored, an empty table gives no rows.
    """
    model = learn(docs, doc_id, text, lang, s)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = packed(docs, doc_id, text).select(F.col(f"`{doc_id}`").alias("doc_id"), held_out(doc_id).alias("held_out"), blank(text).alias("text"), has_letter(F.col(f"`{text}`")).alias("letter"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2, 128, 1 << 20):
            said = [(UNDETERMINED, 0.0, True)] * part.num_rows
            if shared.value is not None:
                letter = part.column(3).to_pylist()
                found = shared.value.identify(part.column(2).to_pylist(), s)
                said = [f if ok else u for f, ok, u in zip(found, letter, said)]
            names = ["lang_pred", "score", "rejected"]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *[pa.array(x) for x in zip(*said)]], names=["doc_id", "held_out", *names])

    done = rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean")
    return done.withColumnRenamed("doc_id", doc_id)
