"""Approximate nearest neighbours by multi-index hashing over learned rotated binary codes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.frames import keep, packed

BITS, BYTE = 256, 8
PARTS = BITS // BYTE  # substrings, one byte each
STRIDE = 8  # substrings probed between two looks at what was found
SAMPLE = 8192
POOL = 500
INDEX_BLOCK, QUERY_BLOCK = 16384, 2048

DISTANCE = np.array([[bin(a ^ b).count("1") for b in range(256)] for a in range(256)], np.uint8)
#: SHELLS[r][b]: the bytes that differ from b in exactly r bits.
SHELLS = [np.array([np.flatnonzero(DISTANCE[b] == r) for b in range(256)]) for r in range(BYTE + 1)]


@dataclass
class Coder:
    """Codes are signs of several learned rotations of a vector. `longest` is the largest norm: a vector is given one
    more component that lifts it to this norm, a query 0, so that the largest inner product has the least angle."""

    longest: float
    turns: np.ndarray

    def codes(self, vectors: np.ndarray, query: bool) -> np.ndarray:
        lift = np.zeros(len(vectors)) if query else np.sqrt(np.maximum(self.longest**2 - (vectors**2).sum(1), 0))
        scale = np.linalg.norm(vectors, axis=1) if query else np.full(len(vectors), self.longest)
        unit = np.column_stack([vectors, lift]) / np.maximum(scale, 1e-300)[:, None]
        return np.packbits(unit @ self.turns > 0, axis=1)


def learn_coder(sample: np.ndarray, longest: float, dim: int, rounds: int = 25, seed: int = 5) -> Coder:
    """Iterative quantization: from random starts, rotations that bring the principal components near their signs."""
    rng, width, turns = np.random.default_rng(seed), dim + 1, []
    lift = np.sqrt(np.maximum(longest**2 - (sample**2).sum(1), 0)) if len(sample) else np.zeros(0)
    data = np.column_stack([sample, lift]) / longest if len(sample) else np.zeros((0, width))
    basis = np.linalg.eigh(data.T @ data)[1] if len(data) else np.eye(width)
    for _ in range(-(-BITS // width)):
        turn = np.linalg.qr(rng.normal(size=(width, width)))[0]
        for _ in range(rounds if len(data) else 0):
            rotated = data @ basis @ turn
            u, _, v = np.linalg.svd((data @ basis).T @ np.where(rotated > 0, 1.0, -1.0))
            turn = u @ v
        turns.append(basis @ turn)
    return Coder(longest, np.concatenate(turns, 1)[:, :BITS])


class MultiIndex:
    """A posting list of rows per substring and byte value, all in one array."""

    def __init__(self, codes: np.ndarray):
        self.words = np.ascontiguousarray(codes).view(np.uint64)
        keys = (codes.astype(np.int64) + 256 * np.arange(PARTS)).T.reshape(-1)
        order = np.argsort(keys, kind="stable")
        self.rows = (order % max(len(codes), 1)).astype(np.int32)
        self.starts = np.searchsorted(keys[order], np.arange(256 * PARTS + 1))

    def within(self, code: np.ndarray, pool: int) -> np.ndarray:
        """Every row within the smallest Hamming radius that holds `pool` rows (all rows, if fewer).

        Pigeonhole: a code within PARTS * t + a bits has t bits or fewer of difference in one of the first a + 1
        substrings, or fewer than t in one of the others. So once the first a + 1 are probed to t bits
        and the others to t - 1, no code within that radius is missing.
        """
        n, word = len(self.words), np.ascontiguousarray(code).view(np.uint64)
        seen, far = np.zeros(n, bool), np.full(n, BITS + 1, np.int64)
        for t, shell in enumerate(SHELLS):
            for at in range(0, PARTS, STRIDE):
                keys = (shell[code[at : at + STRIDE]] + 256 * np.arange(at, at + STRIDE)[:, None]).reshape(-1)
                begin, size = self.starts[keys], self.starts[keys + 1] - self.starts[keys]
                ends = np.cumsum(size)
                met = np.zeros(n, bool)
                met[self.rows[np.arange(ends[-1]) + np.repeat(begin - ends + size, size)]] = True
                new = np.flatnonzero(met & ~seen)
                seen[new] = True
                far[new] = np.bitwise_count(self.words[new] ^ word).sum(1)
                if np.count_nonzero(far < PARTS * t + at + STRIDE) >= min(pool, n):
                    return np.flatnonzero(far <= np.partition(far, min(pool, n) - 1)[min(pool, n) - 1])
        return np.flatnonzero(seen)


def sound(vector: Column) -> Column:
    """Not null, not zero, all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(vectors: DataFrame, queries: Column, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", pool: int = POOL) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row that `queries` (on vec_id) selects the k found with the
    largest inner product in double precision, ties to the smaller id, the query itself left out; all, if fewer.

    Vectors that are not `sound`, null ids, and vectors whose length is not the commonest (the longer of equally
    common ones) take no part. Rows that repeat an id are one row, with the smallest vector. An empty table gives no rows.

    Equal vectors are indexed once with their k + 1 smallest ids, which is all any query can need. The coder is
    learned from at most SAMPLE distinct vectors, the smallest by hash. Blocks of index rows meet blocks of queries;
    in each, multi-index hashing finds the codes around a query, and exact products rank them. Only k rows a block
    and query leave a task.
    """
    spark = vectors.sparkSession
    rows = packed(vectors, vec_id, embedding).select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{embedding}`").cast("array<double>").alias("v"))
    rows = rows.filter(F.col("id").isNotNull() & sound(F.col("v"))).groupBy("id").agg(F.min("v").alias("v"))
    rows = keep(rows, "ann-rows")
    schema = "query_id long, rank int, vec_id long, score double"
    common = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    if common is None:
        return spark.createDataFrame([], schema)
    dim = common.dim
    rows = rows.filter(F.size("v") == dim)
    few = rows.withColumn("place", F.row_number().over(Window.partitionBy("v").orderBy("id"))).filter(F.col("place") <= k + 1)
    distinct = keep(few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")), "ann-distinct")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    total, longest = distinct.agg(F.count("*"), F.max(norm)).first()
    sample = distinct.select("v").orderBy(F.xxhash64("v"), "v").limit(SAMPLE).collect()
    coder = spark.sparkContext.broadcast(learn_coder(np.array([r.v for r in sample], float).reshape(-1, dim), longest, dim))
    asked = rows.filter(queries)
    index_blocks, query_blocks = max(1, -(-total // INDEX_BLOCK)), max(1, -(-asked.count() // QUERY_BLOCK))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    index = distinct.select(F.pmod(F.xxhash64("v"), F.lit(index_blocks)).cast("int").alias("i"), spread(query_blocks).alias("q"), "v", "ids")
    asked = asked.select(spread(index_blocks).alias("i"), F.pmod(F.xxhash64("id"), F.lit(query_blocks)).cast("int").alias("q"), "id", "v")

    def search(index: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(index) and len(asked):
            data, wanted = np.vstack(index["v"].to_numpy()), np.vstack(asked["v"].to_numpy())
            built = MultiIndex(coder.value.codes(data, False))
            ids, sizes = np.concatenate(index["ids"].to_numpy()), index["ids"].map(len).to_numpy()
            starts = np.cumsum(sizes) - sizes
            for own, vector, code in zip(asked["id"].to_numpy(), wanted, coder.value.codes(wanted, True)):
                near = built.within(code, pool)
                scores = data[near] @ vector
                if len(near) > 2 * k + 2:  # each has an id, at most one of them the query's
                    best = scores >= np.partition(scores, len(scores) - k - 1)[len(scores) - k - 1]
                    near, scores = near[best], scores[best]
                size = sizes[near]
                place = np.arange(size.sum()) + np.repeat(starts[near] - np.cumsum(size) + size, size)
                found, score = ids[place], np.repeat(scores, size)
                found, score = found[found != own], score[found != own]
                top = np.lexsort((found, -score))[:k]
                out.append((np.full(len(top), own), found[top], score[top]))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)]
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), columns)))

    found = index.groupBy("i", "q").cogroup(asked.groupBy("i", "q")).applyInPandas(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast(T.IntegerType()), "vec_id", "score")
