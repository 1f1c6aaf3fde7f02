"""Best-fit packing of texts into sequences of several permitted lengths."""

from __future__ import annotations

import bisect
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.frames import blank, materialize, packed

SIZES = (2048, 4096, 8192, 16384, 32768)
GROUP_ITEMS = 50_000


def costs(sizes: Sequence[int], linear: float = 1.0, square: float = 1 / 131072, fixed: float = 32.0) -> list[float]:
    """Cost of a sequence of each size: a fixed part, one per token and one for attention over all pairs."""
    return [fixed + linear * c + square * c * c for c in sizes]


def best_fit(lengths: Sequence[int], sizes: Sequence[int], prices: Sequence[float], floor: int) -> tuple[list[int], list[int], list[int], float]:
    """(bin of each item, its offset, final size of each bin, total cost) for items in the given order.

    An item goes to the open bin with the least room that holds it; else a bin is opened of the least-cost
    size that holds the item and is at least `floor`. In the end each bin shrinks to the least-cost size
    that holds its contents.
    """
    order = sorted(range(len(sizes)), key=lambda k: (prices[k], sizes[k]))
    rooms: list[tuple[int, int]] = []  # (room left, bin), sorted
    used: list[int] = []
    of, at = [], []
    for length in lengths:
        k = bisect.bisect_left(rooms, (length, -1))
        if k < len(rooms):
            room, b = rooms.pop(k)
        else:
            b = len(used)
            room = next(sizes[s] for s in order if sizes[s] >= max(length, floor))
            used.append(0)
        of.append(b)
        at.append(used[b])
        used[b] += length
        if room > length:
            bisect.insort(rooms, (room - length, b))
    final = [next(s for s in order if sizes[s] >= u) for u in used]
    return of, at, [sizes[s] for s in final], sum(prices[s] for s in final)


def pack_group(lengths: np.ndarray, sizes: Sequence[int], prices: Sequence[float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, offset and bin size per item: best fit, longest first, under every opening floor; the cheapest plan stays."""
    order = np.argsort(-lengths, kind="stable")
    plans = [best_fit(lengths[order].tolist(), sizes, prices, floor) for floor in sizes]
    of, at, final, _ = min(plans, key=lambda p: p[3])
    bins, offsets = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    bins[order], offsets[order] = of, at
    return bins, offsets, np.array(final, np.int64)[bins] if len(order) else bins


def pack_texts(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: Column | None = None, sizes: Sequence[int] = SIZES, group_items: int = GROUP_ITEMS
) -> DataFrame:
    """One row per piece of each row of `docs`: doc_id, piece, start, length, bin, bin_size, bin_offset.

    `length` is a text's number of tokens (default: UTF-8 bytes, as byte-level models count); one separator is added,
    so an empty or null text is one token. A text longer than the largest size is cut into pieces of that size and the rest.
    Rows that repeat are packed each; an empty table gives no rows.

    Pieces are dealt at random, independent of keys and sources, to groups of about `group_items`, each packed
    in one task under all opening floors. Bins never span groups, which costs a few part-filled bins
    a group. Only ids and lengths are shuffled; they are written before, so a retried task sees the same groups.
    """
    sizes = sorted(sizes)
    top = sizes[-1]
    rows = packed(docs, doc_id, text)
    tokens = (F.octet_length(blank(text)) if length is None else length).cast("long") + 1
    items = rows.select(F.col(f"`{doc_id}`").alias("doc"), tokens.alias("tokens"))
    items = items.select("doc", "tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("tokens") - 1) / top))).alias("piece"))
    items = items.select("doc", F.col("piece").cast("int").alias("piece"), (F.col("piece") * top).alias("start"), F.least(F.lit(top), F.col("tokens") - F.col("piece") * top).alias("length"))
    items = materialize(items.withColumn("dealt", F.rand(17)), "pack-items")
    groups = max(1, -(-items.count() // group_items))
    schema = T.StructType(
        [T.StructField(doc_id, rows.schema[doc_id].dataType), T.StructField("piece", T.IntegerType())]
        + [T.StructField(n, T.LongType()) for n in ("start", "length", "bin", "bin_size", "bin_offset")]
    )
    prices = costs(sizes)

    def run(key: tuple, items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["length", "dealt"], kind="stable").reset_index(drop=True)
        bins, offsets, final = pack_group(items["length"].to_numpy(), sizes, prices)
        done = items[["doc", "piece", "start", "length"]].rename(columns={"doc": doc_id})
        return done.assign(bin=(int(key[0]) << 32) + bins, bin_size=final, bin_offset=offsets)

    return items.withColumn("pack", F.floor(F.col("dealt") * groups).cast("long")).groupBy("pack").applyInPandas(run, schema)
