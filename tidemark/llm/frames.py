"""Small helpers the operators of this package share."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import materialize, shared_dir

__all__ = ["blank", "keep", "keep_rows", "materialize", "packed", "shared_dir", "slices", "table", "unused"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blank(text: str | Column) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def keep(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """`materialize` for wide results: a stronger codec, as the files count as cluster disk."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(taken: Iterable[str], name: str) -> str:
    """`name`, with underscores added until no input column (in any case) has it."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name


def packed(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns of the caller cannot clash."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def slices(batches: Iterable, column: int, rows: int, size: int = 2 << 20) -> Iterator:
    """Parts of Arrow batches of at most `rows` rows and about `size` bytes of a text column, so that what a task
    holds does not grow with the length of texts that happen to stand together."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            stop = max(at + 1, min(at + rows, int(np.searchsorted(ends, before + size, "right"))))
            yield batch.slice(at, stop - at)
            at = stop


#: Ids up to this count are sent to all executors (16 bytes each); beyond it the rows are shuffled to them.
SENT_IDS = 2_000_000


def keep_rows(docs: DataFrame, decided: DataFrame, doc_id: str, text_key: Column) -> DataFrame:
    """The rows of `docs` that `decided` (doc_id, key, kept: one row per row of docs) keeps, with all columns.

    Ids of dropped rows are anti-joined, so that texts stay where they are while those ids are few. An id with
    both kept and dropped rows is settled by `text_key`, which gives the key of a row of docs; of several rows with one
    id and key, all or one are kept, and then the smallest.
    """
    decided = materialize(decided, "decided")
    per_id = decided.groupBy("doc_id").agg(F.min("kept").alias("all"), F.max("kept").alias("any")).filter("not all")
    dropped = materialize(per_id, "dropped")
    ids = dropped.select(F.col("doc_id").alias(mark := unused(docs.columns, "_id")))
    sent = F.broadcast if dropped.count() <= SENT_IDS else lambda x: x
    same = docs[f"`{doc_id}`"].eqNullSafe(ids[mark])
    rest = docs.join(sent(ids), same, "left_anti")
    mixed = dropped.filter("any").select("doc_id")
    if mixed.isEmpty():
        return rest
    counts = decided.join(mixed, decided["doc_id"].eqNullSafe(mixed["doc_id"]), "left_semi").groupBy("doc_id", "key").agg(F.sum(F.col("kept").cast("int")).alias("keep"))
    key, place, wanted = (unused(docs.columns, n) for n in ("_key", "_place", "_wanted"))
    counts = counts.filter("keep > 0").select(F.col("doc_id").alias(mark), F.col("key").alias(f"{key}_"), F.col("keep").alias(wanted))
    twins = docs.withColumn(key, text_key).join(counts, docs[f"`{doc_id}`"].eqNullSafe(counts[mark]) & (F.col(key) == F.col(f"{key}_")))
    order = Window.partitionBy(f"`{doc_id}`", key).orderBy(*[F.col(f"`{c}`") for c, t in docs.dtypes if not t.startswith("map")])
    return rest.unionByName(twins.withColumn(place, F.row_number().over(order)).filter(F.col(place) <= F.col(wanted)).select(*[f"`{c}`" for c in docs.columns]))
