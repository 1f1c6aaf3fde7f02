"""Near-duplicate classes: ProbMinHash, banding, and exact verification of probability Jaccard.

1. Each text becomes a weighted set of word shingles; texts with equal sets are one content from here on.
2. Contents that share a band meet in its bucket. A bucket is read once against its leaders: a content is tied to
   every leader it resembles loosely, and becomes a leader itself unless it resembles one closely. By the triangle
   inequality of the distance 1 - J, contents linked at the threshold then always share a coarse class, though
   only leaders are kept in memory and no pairs are listed.
3. Inside a coarse class, tiles against tiles, pairs whose registers agree enough are verified exactly, most
   similar first, unless verified links join them already. Classes are the components of verified links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.llm.frames import blank, keep, keep_rows, materialize, packed, slices
from tidemark.llm.links import components
from tidemark.llm.probminhash import WordHashes, bands, shingles, signatures, similarity

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 32, 6
REGISTERS = BANDS * ROWS
#: Of the estimate's standard deviation at the threshold, about 0.029: how far below it pairs are still verified.
SLACK = 0.13
#: Estimated similarity from which a content is tied to a leader, and from which it need not lead itself. Their
#: difference is 1 - THRESHOLD and a margin for both estimates.
LOOSE, CLOSE = 0.44, 0.76
TILE = 600
SKETCHED = "row long, doc_id {id}, text_hash long, key binary, bands array<long>, registers binary, text string"


def _estimates(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Estimated similarity from the shares of equal register bytes, less their chance agreement."""
    return ((many == one).mean(axis=-1) - 1 / 256) / (1 - 1 / 256)


def _sketch(id_type: pa.DataType):
    schema = pa.schema([("row", pa.int64()), ("doc_id", id_type), ("text_hash", pa.int64()), ("key", pa.binary()), ("bands", pa.list_(pa.int64())), ("registers", pa.binary()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, hashes, seen = TaskContext.get().partitionId() << 33, WordHashes(), set()
        for part in slices(batches, 1, 400):
            texts = part.column(1).to_pylist()
            sets = [shingles(t, WORDS, hashes) for t in texts]
            keys = [hashlib.blake2b(e.tobytes() + w.tobytes(), digest_size=16).digest() for e, w in sets]
            new = []
            for k, key in enumerate(keys):
                if key not in seen:
                    if len(seen) >= 1 << 20:
                        seen.clear()
                    seen.add(key)
                    new.append(k)
            won = signatures([sets[k] for k in new], REGISTERS)
            hashed, low = bands(won, ROWS).view(np.int64), (won >> np.uint64(13)).astype(np.uint8)
            of = {k: i for i, k in enumerate(new)}
            signed = [k in of and len(sets[k][0]) > 0 for k in range(len(texts))]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(at, at + len(texts)), pa.int64()),
                    part.column(0).cast(id_type),
                    part.column(2),
                    pa.array(keys, pa.binary()),
                    pa.array([hashed[of[k]] if s else None for k, s in enumerate(signed)], pa.list_(pa.int64())),
                    pa.array([low[of[k]].tobytes() if s else None for k, s in enumerate(signed)], pa.binary()),
                    pa.array([t if s else None for t, s in zip(texts, signed)], pa.string()),
                ],
                schema=schema,
            )
            at += len(texts)

    return run


class Joined:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def top(self, k: int) -> int:
        while self.up[k] != k:
            self.up[k] = self.up[self.up[k]]
            k = self.up[k]
        return k

    def join(self, a: int, b: int) -> None:
        a, b = self.top(a), self.top(b)
        self.up[max(a, b)] = min(a, b)


def _lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, row, registers), sorted by bucket: ties (a, b) whose components are those of all ties between
    contents and the leaders they resemble. A tie between what is tied already is left out."""
    bucket, leaders, regs, count = None, [], np.zeros((64, REGISTERS), np.uint8), 0
    tied = Joined(0)
    for batch in batches:
        buckets, rows = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        registers = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, REGISTERS)
        a, b = [], []
        for k in range(len(rows)):
            if buckets[k] != bucket:
                bucket, leaders, count, tied = buckets[k], [], 0, Joined(0)
            near = _estimates(registers[k], regs[:count]) if count else np.zeros(0)
            alike = np.flatnonzero(near >= LOOSE).tolist()
            tops = {tied.top(j): j for j in reversed(alike)}
            for j in tops.values():
                a.append(rows[k])
                b.append(leaders[j])
            for j in alike[1:]:
                tied.join(alike[0], j)
            if not count or near.max() < CLOSE:
                if count == len(regs):
                    regs = np.concatenate([regs, np.zeros_like(regs)])
                regs[count] = registers[k]
                leaders.append(rows[k])
                tied.up.append(count)
                if alike:
                    tied.join(alike[0], count)
                count += 1
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def verified_stars(rows: list[int], registers: np.ndarray, texts: list[str], side: np.ndarray, threshold: float) -> tuple[list[int], list[int]]:
    """Links (a, b), as stars, whose components are those of all pairs of at least the threshold.

    side: 0 or 1 for the two tiles, whose pairs across count; all 0 for a tile by itself.
    """
    n, hashes, sets = len(rows), WordHashes(), {}
    pairs, scores = [], []
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    across = len(right) > 0
    for k in left:
        others = right if across else left[left > k]
        if len(others):
            near = _estimates(registers[k], registers[others])
            good = near >= threshold - SLACK
            pairs.append(np.stack([np.full(good.sum(), k), others[good]], 1))
            scores.append(near[good])
    if not pairs:
        return [], []
    pairs, scores = np.concatenate(pairs), np.concatenate(scores)
    joined = Joined(n)
    for k in np.argsort(-scores, kind="stable"):
        i, j = pairs[k].tolist()
        if joined.top(i) == joined.top(j):
            continue
        for x in (i, j):
            if x not in sets:
                sets[x] = shingles(texts[x], WORDS, hashes)
        if similarity(sets[i], sets[j]) >= threshold:
            joined.join(i, j)
    tops = [joined.top(k) for k in range(n)]
    return [rows[k] for k in range(n) if tops[k] != k], [rows[t] for k, t in enumerate(tops) if t != k]


def near_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of `docs`: doc_id, class_id, class_size, kept, text_hash.

    A class is a component of links of at least `threshold` between word-shingle sets, equal sets included.
    class_id is its smallest id; the row with it stays (of several with that id exactly one, nulls last). Null texts are
    empty; texts without words are one class. Extra columns are ignored; an empty table gives no rows.
    """
    rows = packed(docs, doc_id, text).select(F.col(f"`{doc_id}`").alias("doc_id"), blank(text).alias("text"), F.xxhash64(blank(text)).alias("text_hash"))
    id_type = rows.schema["doc_id"].dataType
    sketched = keep(rows.mapInArrow(_sketch(to_arrow_type(id_type)), SKETCHED.format(id=id_type.simpleString())), "near-sketch")
    # The first row that carries a content's sketch stands for it.
    owners = sketched.groupBy("key").agg(F.min(F.when(F.col("bands").isNotNull(), F.col("row"))).alias("owner"), F.min("row").alias("first"))
    owners = materialize(owners.select("key", F.coalesce("owner", "first").alias("owner")), "near-owners")
    own = sketched.filter("bands is not null").select("row", "key", "bands").join(owners.select("key", F.col("owner").alias("row")), ["key", "row"], "left_semi")
    banded = own.select("row", F.posexplode("bands").alias("band", "hash")).select("row", F.xxhash64("band", "hash").alias("bucket"))
    shared = banded.withColumn("n", F.count("*").over(Window.partitionBy("bucket"))).filter("n > 1").select("bucket", "row")
    shared = materialize(shared, "near-shared")
    signed = sketched.filter("bands is not null").select("row", "registers")
    dealt = shared.join(signed, "row").select("bucket", "row", "registers")
    ties = dealt.repartition("bucket").sortWithinPartitions("bucket", "row").mapInArrow(_lead, "a long, b long")
    coarse = components(ties)
    sizes = coarse.groupBy("label").agg(F.count("*").alias("n"))
    placed = materialize(coarse.join(sizes, "label").select("node", "label", F.ceil(F.col("n") / TILE).cast("int").alias("tiles")), "near-coarse")
    members = placed.join(sketched.filter("bands is not null").select(F.col("row").alias("node"), "registers", "text"), "node")
    members = members.withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    met = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    met = met.select("node", "label", "registers", "text", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), (F.col("tile") > F.col("other")).cast("int").alias("side"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (label, i, j): each run is one pair of tiles."""
        held: list[tuple] = []
        mark = None

        def done() -> pa.RecordBatch:
            nodes, registers, texts, sides = zip(*held)
            packed_registers = np.frombuffer(b"".join(registers), np.uint8).reshape(-1, REGISTERS)
            a, b = verified_stars(list(nodes), packed_registers, list(texts), np.array(sides), threshold)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(7)]
            for node, label, registers, text_, i, j, side in zip(*columns):
                if (label, i, j) != mark:
                    if len(held) > 1:
                        yield done()
                    held, mark = [], (label, i, j)
                held.append((node, registers, text_, side))
        if len(held) > 1:
            yield done()

    links = met.repartition("label", "i", "j").sortWithinPartitions("label", "i", "j", "node").mapInArrow(verify, "a long, b long")
    classes = components(links)
    of_key = owners.join(classes.select(F.col("node").alias("owner"), "label"), "owner", "left").select("key", F.coalesce("label", "owner").alias("class"))
    found = materialize(sketched.select("row", "doc_id", "text_hash", "key").join(of_key, "key").select("row", "doc_id", "text_hash", "class"), "near-classes")
    best = found.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "row")).alias("best"), F.count("*").alias("class_size"))
    return found.join(best, "class").select(F.col("doc_id").alias(doc_id), F.col("best.doc_id").alias("class_id"), "class_size", (F.col("row") == F.col("best.row")).alias("kept"), "text_hash")


def drop_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` that stay, one of each class, with all columns."""
    classes = near_classes(docs, doc_id, text, threshold).select(F.col(f"`{doc_id}`").alias("doc_id"), F.col("text_hash").alias("key"), "kept")
    return keep_rows(docs, classes, doc_id, F.xxhash64(blank(text)))
