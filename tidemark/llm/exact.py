"""Exact deduplication: Patricia tries over length-and-content-hash partitions own each distinct text."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.llm.frames import blank, keep_rows, packed, shared_dir
from tidemark.llm.trie import PatriciaTrie


def normalised(text: str | Column) -> Column:
    """Each run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(blank(text), r"[\x20\x09-\x0D]+", " ")


def _rank(doc_id, row: int) -> tuple:
    """Owners go by id, null ids last, then by row."""
    return (0, doc_id, row) if doc_id is not None else (1, 0, row)


def _local_owners(id_type: pa.DataType, budget: int):
    """Per task: each row with the number of its text, then each distinct text once, with its smallest owner and count."""
    schema = pa.schema([("kind", pa.string()), ("local", pa.int64()), ("doc_id", id_type), ("row", pa.int64()), ("sha256", pa.string()), ("n", pa.int64()), ("body", pa.binary())])

    def distinct(trie: PatriciaTrie) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for key, node in trie.terminals():
            local, sha = node.members[0]
            out.append(("text", local, node.owner[1] if node.owner[0] == 0 else None, node.owner[2], sha, node.count, key))
            held += len(key)
            if held > 8 << 20 or len(out) >= 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 33
        trie, rows = PatriciaTrie(1 << 62), 0
        for batch in batches:
            ids, shas, bodies = (batch.column(i) for i in range(3))
            ids, shas, locals_ = ids.to_pylist(), shas.to_pylist(), []
            for k in range(len(ids)):
                node = trie.insert(bodies[k].as_py(), _rank(ids[k], base + rows + k), 1)
                if not node.members:
                    node.members.append((base + rows + k, shas[k]))
                locals_.append(node.members[0][0])
            n = len(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array(["row"] * n), pa.array(locals_, pa.int64()), batch.column(0).cast(id_type), pa.array(range(base + rows, base + rows + n), pa.int64()), batch.column(1).cast(pa.string()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())],
                schema=schema,
            )
            rows += n
            if trie.bytes > budget:
                yield from distinct(trie)
                trie = PatriciaTrie(1 << 62)
        yield from distinct(trie)

    return run


def _merge_owners(id_type: pa.DataType, budget: int):
    """Per partition of (length, content hash): one trie over the tasks' distinct texts; for each its final owner and count."""
    schema = pa.schema([("local", pa.int64()), ("keep_id", id_type), ("keep_row", pa.int64()), ("group_size", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PatriciaTrie(budget)
        for batch in batches:
            local, ids, rows, counts = (batch.column(i).to_pylist() for i in range(4))
            bodies = batch.column(4)
            for k in range(len(local)):
                trie.insert(bodies[k].as_py(), _rank(ids[k], rows[k]), counts[k], local[k])
        out = []
        for _, node in trie.terminals():
            owner = node.owner[1] if node.owner[0] == 0 else None
            out.extend((m, owner, node.owner[2], node.count) for m in node.members)
            if len(out) >= 10000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return run


def exact_owners(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", budget: int = 64 << 20) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when `normalised` makes them identical. The row with the smallest id stays; nulls are
    last, and of rows with that same id exactly one stays. Null texts are empty texts, and all empty ones are
    equal. Extra columns are ignored; an empty table gives no rows.

    Each input task folds its rows in a trie first, so a text with any number of copies leaves at most one
    string per task (and per `budget` bytes of distinct text). These strings are shuffled by length and SHA-256 and
    inserted whole into the partition's trie, which decides equality by bytes; it spills subtrees beyond
    `budget`. The texts travel once; the rows then meet their owners over the task-local text number.
    """
    rows = packed(docs, doc_id, text)
    id_field = rows.schema[doc_id]
    id_type = to_arrow_type(id_field.dataType)
    body = rows.select(F.col(f"`{doc_id}`").alias("doc_id"), normalised(text).cast("binary").alias("body"))
    body = body.select("doc_id", F.sha2("body", 256).alias("sha256"), "body")
    local_schema = T.StructType(
        [T.StructField("kind", T.StringType()), T.StructField("local", T.LongType()), T.StructField("doc_id", id_field.dataType), T.StructField("row", T.LongType())]
        + [T.StructField("sha256", T.StringType()), T.StructField("n", T.LongType()), T.StructField("body", T.BinaryType())]
    )
    path = f"{shared_dir(docs.sparkSession)}/exact-{uuid.uuid4().hex}"
    body.mapInArrow(_local_owners(id_type, budget), local_schema).write.option("compression", "zstd").partitionBy("kind").parquet(path)
    found = docs.sparkSession.read.schema(local_schema).parquet(path)
    texts = found.filter("kind = 'text'").select("local", "doc_id", "row", "n", "body", "sha256", F.octet_length("body").alias("length"))
    merged_schema = T.StructType(
        [T.StructField("local", T.LongType()), T.StructField("keep_id", id_field.dataType), T.StructField("keep_row", T.LongType()), T.StructField("group_size", T.LongType())]
    )
    owners = texts.repartition("length", "sha256").select("local", "doc_id", "row", "n", "body").mapInArrow(_merge_owners(id_type, budget), merged_schema)
    return (
        found.filter("kind = 'row'")
        .select("local", "doc_id", "row", "sha256")
        .join(owners, "local")
        .select(F.col("doc_id").alias(doc_id), "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.col("sha256").alias("text_sha256"))
    )


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with all columns and their own text."""
    owners = exact_owners(docs, doc_id, text).select(F.col(f"`{doc_id}`").alias("doc_id"), F.col("text_sha256").alias("key"), "kept")
    return keep_rows(docs, owners, doc_id, F.sha2(normalised(text).cast("binary"), 256))
