"""Removal of repeated byte strings by suffix arrays of anchored segments.

Equal strings of `width` bytes contain the same least-hashed `anchor`-byte string, so a document is cut into segments,
runs of strings with one anchor occurrence, and only segments with equal anchors can share a string. Anchors that occur once
end there. Equal segments are one content. Contents that share an anchor are suffix-sorted together, column by column
(`columnwise`), and neighbours with a common prefix of `width` bytes are the repeats.

The strings of an anchor with many contents are counted instead. Equal strings have their first occurrence of the anchor
at the same offset, so the bytes that all strings with a run of offsets have in common are a key: keys that
occur once are dropped, and only strings under the others are counted, all with partial aggregates.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.llm.columnwise import repeated_starts
from tidemark.llm.frames import blank, keep, materialize, packed
from tidemark.llm.probminhash import mix

WIDTH, ANCHOR = 400, 200
CHUNK = 1 << 18  # strings of a document handled at once
COLLECTION = 200_000  # bytes of contents suffix-sorted together; strings of an anchor with more are counted
OFFSETS = 16  # of the anchor in a string, that share a key
BASE = 0x9E3779B97F4A7C15  # odd, for rolling hashes modulo 2^64

CUT = "row long, doc_id {id}, n_bytes long, packed binary, starts array<int>, counts array<int>, anchors array<long>, contents array<long>"


class Cutter:
    """Segments of byte strings: first start, number of starts, anchor hash and content hash."""

    def __init__(self, width: int, anchor: int):
        self.width, self.anchor = width, anchor
        n = CHUNK + width
        with np.errstate(over="ignore"):
            self.powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, BASE, np.uint64)]))
            self.inverse = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, pow(BASE, -1, 1 << 64), np.uint64)]))

    def cut(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        parts = [self._chunk(data[k : k + CHUNK + self.width - 1], k) for k in range(0, max(len(data) - self.width + 1, 0), CHUNK)]
        return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64))

    def hashes(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rolling sums, and the hash of each `anchor`-byte string."""
        anchor, n = self.anchor, len(data)
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.powers[:n])])
            return sums, mix((sums[anchor:] - sums[:-anchor]) * self.inverse[: n - anchor + 1])

    def _chunk(self, data: np.ndarray, offset: int) -> tuple[np.ndarray, ...]:
        width, anchor = self.width, self.anchor
        sums, hashes = self.hashes(data)
        least, span, wanted = hashes, 1, width - anchor + 1
        while span * 2 <= wanted:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < wanted:
            rest = wanted - span
            least = np.minimum(least[:-rest], least[rest:])
        # A new segment where the anchor changes or its occurrence is left behind.
        first = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (hashes[: len(least) - 1] == least[:-1])]))
        count = np.diff(first, append=len(least))
        end = first + count - 1 + width
        with np.errstate(over="ignore"):
            content = mix(mix((sums[end] - sums[first]) * self.inverse[first]) + (end - first).astype(np.uint64))
        return first + offset, count, least[first], content


def _cut_texts(id_type: pa.DataType, width: int, anchor: int):
    lists = [pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]
    names = ["row", "doc_id", "n_bytes", "packed", "starts", "counts", "anchors", "contents"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, cutter, press = TaskContext.get().partitionId() << 33, Cutter(width, anchor), zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for start in range(0, batch.num_rows, 300):
                part = batch.slice(start, 300)
                bodies = part.column(1).to_pylist()
                cuts = [cutter.cut(np.frombuffer(b, np.uint8)) for b in bodies]
                stops = np.cumsum([0] + [len(c[0]) for c in cuts])
                flat = [np.concatenate([c[k] for c in cuts]) for k in range(4)]
                flat = [flat[0].astype(np.int32), flat[1].astype(np.int32), flat[2].view(np.int64), flat[3].view(np.int64)]
                arrays = [pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.array(x)).cast(t) for x, t in zip(flat, lists)]
                n = len(bodies)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(at, at + n), pa.int64()), part.column(0).cast(id_type), pa.array([len(b) for b in bodies], pa.int64()), pa.array([press.compress(b) for b in bodies], pa.binary()), *arrays],
                    names=names,
                )
                at += n

    return run


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (packed, places: start, end, anchor, content, hot): the bytes of each place."""
    for batch in batches:
        for k in range(batch.num_rows):
            data = zstandard.decompress(batch.column(0)[k].as_py())
            places = batch.column(1)[k].as_py()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([p["anchor"] for p in places], pa.int64()),
                    pa.array([p["content"] for p in places], pa.int64()),
                    pa.array([data[p["start"] : p["end"]] for p in places], pa.binary()),
                    pa.array([p["hot"] for p in places], pa.bool_()),
                ],
                names=["anchor", "content", "body", "hot"],
            )


def _sort_suffixes(width: int, budget: int):
    """Rows (anchor, content, body), sorted by anchor: the runs of starts in each content that repeat."""

    def done(held: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        found = repeated_starts([h[2] for h in held], width)
        firsts, counts = [], []
        for starts in found:
            breaks = np.flatnonzero(np.diff(starts, prepend=-2) != 1)
            firsts.append(starts[breaks].tolist())
            counts.append(np.diff(breaks, append=len(starts)).tolist())
        kind = pa.list_(pa.int32())
        return pa.RecordBatch.from_arrays([pa.array([h[0] for h in held], pa.int64()), pa.array([h[1] for h in held], pa.int64()), pa.array(firsts, kind), pa.array(counts, kind)], names=["anchor", "content", "firsts", "runs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes]] = []
        size = 0
        for batch in batches:
            for anchor, content, body in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if size > budget and anchor != held[-1][0]:
                    yield done(held)
                    held, size = [], 0
                held.append((anchor, content, body))
                size += len(body)
        if held:
            yield done(held)

    return run


def _keys(width: int, anchor: int, offsets: int):
    """Rows (anchor, content, body, groups): (anchor, content, group, start, key) for each group of `offsets` offsets of the
    anchor in a string, or of those listed in `groups`, if any. Strings of one group are equal only if their keys are;
    with groups of one offset the key is that of the string, and `start` is its start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(width, anchor)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                out = [], [], [], [], []
                for name, content, body, groups in zip(*(batch.column(k).slice(at, 500).to_pylist() for k in range(4))):
                    place = int(np.flatnonzero(cutter.hashes(np.frombuffer(body, np.uint8))[1].view(np.int64) == name)[0])
                    wanted = None if groups is None else {*groups}
                    mark = name.to_bytes(8, "little", signed=True)
                    low, high = place - (len(body) - width), place
                    for group in range(low // offsets, high // offsets + 1):
                        if wanted is not None and group * offsets // OFFSETS not in wanted:
                            continue
                        first, last = place - group * offsets, place - (group * offsets + offsets - 1) + width
                        key = hashlib.blake2b(mark + group.to_bytes(4, "little") + body[first:last], digest_size=16).digest()
                        for column, value in zip(out, (name, content, group, first, key)):
                            column.append(value)
                kinds = pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=["anchor", "content", "group", "start", "key"])

    return run


def _count_strings(bodies: DataFrame, width: int, anchor: int) -> DataFrame:
    """Of rows (anchor, content, body) the starts in each content that repeat, as `_sort_suffixes` gives them. No rows of
    one anchor or key meet in a task: keys are counted with partial aggregates and joined back by plain shuffles."""
    schema = "anchor long, content long, group int, start int, key binary"

    def twice(rows: DataFrame, offsets: int) -> DataFrame:
        keyed = rows.select("anchor", "content", "body", "groups").mapInArrow(_keys(width, anchor, offsets), schema)
        common = materialize(keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "keys-common")
        return keyed.join(common, "key")

    near = twice(bodies.withColumn("groups", F.lit(None).cast("array<int>")), OFFSETS)
    groups = materialize(near.groupBy("anchor", "content").agg(F.collect_set("group").alias("groups")), "groups-common")
    found = twice(bodies.join(groups, ["anchor", "content"]), 1).groupBy("anchor", "content").agg(F.array_sort(F.collect_set("start")).alias("starts"))
    firsts = F.filter("starts", lambda x: ~F.array_contains("starts", x - 1))
    lasts = F.filter("starts", lambda x: ~F.array_contains("starts", x + 1))
    return found.select("anchor", "content", firsts.alias("firsts"), F.zip_with(firsts, lasts, lambda a, b: b - a + 1).alias("runs"))


def _remove(id_type: pa.DataType):
    names = ["doc_id", "n_bytes", "n_removed", "starts", "ends", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                removed, starts, ends, kept = [], [], [], []
                for packed_, spans in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
                    data = zstandard.decompress(packed_)
                    first, end = merge_spans(np.array([(s["start"], s["end"]) for s in spans or []], np.int64).reshape(-1, 2))
                    rest, left = [], 0
                    for a, b in zip(first.tolist(), end.tolist()):
                        rest.append(data[left:a])
                        left = b
                    kept.append(b"".join([*rest, data[left:]]))
                    removed.append(len(data) - len(kept[-1]))
                    starts.append(first)
                    ends.append(end)
                kind = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).cast(id_type), part.column(1), pa.array(removed, pa.int64()), pa.array(starts, kind), pa.array(ends, kind), pa.array(kept, pa.binary())], names=names)

    return run


def merge_spans(spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the union; spans that touch are one."""
    if not len(spans):
        return spans[:, 0], spans[:, 1]
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    begin = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    return spans[begin, 0], reach[np.concatenate([np.flatnonzero(begin)[1:] - 1, [len(spans) - 1]])]


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, anchor: int = ANCHOR, budget: int = COLLECTION) -> DataFrame:
    """One row per row of `docs`: doc_id, n_bytes, n_removed, starts, ends (maximal removed runs), kept (bytes).

    Each byte goes that a `width`-byte string covers which also starts elsewhere, in any row or the same, overlaps
    included; strings never cross rows and are judged on the input. Null texts are empty; repeated rows are
    rows of their own, so their whole strings repeat; extra columns are ignored; an empty table gives no rows.

    Anchors are counted with partial aggregates, copies of a segment are one content before any bytes move, and
    the suffix sort holds at most twice `budget` bytes: the strings of an anchor with more than `budget` bytes of
    contents are counted (`_count_strings`).
    """
    rows = packed(docs, doc_id, text).select(F.col(f"`{doc_id}`").alias("doc_id"), blank(text).cast("binary").alias("body"))
    id_type = to_arrow_type(rows.schema["doc_id"].dataType)
    cut = keep(rows.mapInArrow(_cut_texts(id_type, width, anchor), CUT.format(id=rows.schema["doc_id"].dataType.simpleString())), "segments")
    segments = cut.select("row", F.explode(F.arrays_zip("starts", "counts", "anchors", "contents")).alias("s")).select(
        "row", F.col("s.starts").alias("start"), F.col("s.counts").alias("count"), F.col("s.anchors").alias("anchor"), F.col("s.contents").alias("content")
    )
    # Written, so that the join is one of two plain shuffles, whose hot anchors Spark can split.
    common = materialize(segments.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor"), "anchors-common")
    found = keep(segments.join(common, "anchor"), "segments-common")
    contents = found.groupBy("anchor", "content").agg(F.count("*").alias("n"), F.min(F.struct("row", "start", "count")).alias("one"))
    contents = materialize(contents, "contents")
    sizes = contents.groupBy("anchor").agg(F.count("*").alias("n"), F.sum(F.col("one.count") + width - 1).alias("size"))
    sizes = materialize(sizes.filter("n > 1").select("anchor", (F.col("size") > budget).alias("hot")), "anchors-sizes")
    wanted = contents.join(sizes, "anchor").select(
        F.col("one.row").alias("row"),
        F.struct(F.col("one.start").alias("start"), (F.col("one.start") + F.col("one.count") + width - 1).alias("end"), "anchor", "content", "hot").alias("place"),
    )
    places = wanted.groupBy("row").agg(F.collect_list("place").alias("places"))
    bodies = cut.select("row", "packed").join(places, "row").select("packed", "places").mapInArrow(_fetch, "anchor long, content long, body binary, hot boolean")
    hot = not sizes.filter("hot").isEmpty()
    if hot:
        bodies = keep(bodies, "bodies")
    sorted_ = bodies.filter("not hot").select("anchor", "content", "body").repartition("anchor").sortWithinPartitions("anchor", "content").mapInArrow(_sort_suffixes(width, budget), "anchor long, content long, firsts array<int>, runs array<int>")
    shared = sorted_.filter(F.size("firsts") > 0)
    if hot:
        shared = shared.unionByName(_count_strings(bodies.filter("hot"), width, anchor))
    twice = contents.filter("n > 1").select("anchor", "content", F.array(F.lit(0)).alias("firsts"), F.array(F.col("one.count")).alias("runs"))
    repeats = materialize(shared.join(twice, ["anchor", "content"], "left_anti").unionByName(twice), "repeats")
    spans = found.join(repeats, ["anchor", "content"]).select("row", "start", F.explode(F.arrays_zip("firsts", "runs")).alias("r"))
    spans = spans.select("row", F.struct((F.col("start") + F.col("r.firsts")).alias("start"), (F.col("start") + F.col("r.firsts") + F.col("r.runs") + width - 1).alias("end")).alias("span"))
    spans = spans.groupBy("row").agg(F.collect_list("span").alias("spans"))
    out = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, starts array<long>, ends array<long>, kept binary"
    done = cut.select("row", "doc_id", "n_bytes", "packed").join(spans, "row", "left").select("doc_id", "n_bytes", "packed", "spans").mapInArrow(_remove(id_type), out)
    return done.withColumnRenamed("doc_id", doc_id)
