"""Collocations by prefix-free parsing.

A document is a sequence of words and piece ends. It is parsed into chunks at content triggers, windows of `OVERLAP` words
whose hash is 0 modulo `every`: a chunk runs to the end of the next trigger, so neighbours overlap by the trigger. Equal
passages have equal triggers and so equal chunks, and the distinct chunks with their frequencies in the parse stand for
the whole corpus. An n-gram of up to OVERLAP + 1 words belongs to the one chunk in which it starts before the closing
trigger; n-grams are counted inside distinct chunks only, weighted by the frequency.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.frames import blank, keep, materialize, packed, slices
from tidemark.llm.probminhash import mix

LONGEST = 4  # words of a phrase
OVERLAP = LONGEST - 1
CHUNK = 256  # tokens after which a chunk ends without a trigger
BITS = 1 << 26  # of a filter of frequent phrases: 8 MB, whatever the corpus
HASHES = 1 << 40  # hashes of phrases that are told apart before the filter
BLOCK = 6 << 20  # bytes of chunks counted together
END = b"\n"  # token between pieces; no word holds it
#: Letters to lower-case, blanks, piece ends.
TABLE = bytes.maketrans(bytes(range(65, 91)) + b"\t.,;:!?\x0b\x0c\r", bytes(range(97, 123)) + b" " + END * 9)


@dataclass(frozen=True)
class Settings:
    """least: occurrences of a phrase. covered: percent of a phrase's occurrences inside one longer phrase that
    drop it. top: phrases returned per language. every: triggers are one in so many places."""

    least: int = 30
    covered: int = 80
    top: int = 2000
    every: int = 24


def tokens_of(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """(tokens, text of each): the words, and one END after the last word of each piece that has any."""
    lists = pc.split_pattern(pa.array([t.translate(TABLE).replace(END, b" \n ") + b" \n" for t in texts], pa.binary()), " ")
    tokens, text = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
    some = pc.greater(pc.binary_length(tokens), 0)
    tokens, text = tokens.filter(some), text[some.to_numpy(zero_copy_only=False)]
    end = pc.equal(tokens, END).to_numpy(zero_copy_only=False)
    idle = end & np.concatenate([[True], end[:-1] | (text[1:] != text[:-1])]) if len(end) else end
    return tokens.filter(pa.array(~idle)), text[~idle]


def parse(tokens: pa.Array, text: np.ndarray, every: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, own, stop) of each chunk: its tokens are first to stop - 1, and it owns the `own` first as starts.

    Chunks begin with each text, at each trigger and after CHUNK tokens without one.
    """
    n = len(tokens)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    coded = tokens.dictionary_encode()
    h = np.array([xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)[coded.indices.to_numpy()]
    begins = np.concatenate([[True], text[1:] != text[:-1]])
    with np.errstate(over="ignore"):
        window = np.zeros(max(n - OVERLAP + 1, 0), np.uint64)
        for k in range(OVERLAP):
            window = mix(window * np.uint64(0x9E3779B97F4A7C15) + h[k : n - OVERLAP + 1 + k])
    if len(window):
        begins[: len(window)] |= (window % np.uint64(every) == 0) & (text[: len(window)] == text[OVERLAP - 1 :])
    first = np.flatnonzero(begins)
    long = -(-np.diff(first, append=n) // CHUNK)
    first = np.repeat(first, long) + CHUNK * (np.arange(long.sum()) - np.repeat(np.cumsum(long) - long, long))
    last = np.searchsorted(text, text[first], "right")
    end = np.append(first[1:], n)
    return first, end - first, np.minimum(end + OVERLAP, last)


def ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each range, one after the other."""
    before = np.cumsum(size) - size
    return np.arange(size.sum()) + np.repeat(first - before, size)


def chunk_dictionary(docs: DataFrame, text: str = "text", lang: str = "lang", every: int = Settings.every) -> DataFrame:
    """(lang, chunk, own, freq): the distinct chunks of each language with their frequency in the parse of all documents.
    A chunk's tokens are joined by blanks; `own` is the number of its tokens that the n-grams it counts start at."""
    rows = packed(docs, lang, text).select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), blank(text).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1, 2000):
            tokens, text = tokens_of(part.column(1).to_pylist())
            first, own, stop = parse(tokens, text, every)
            if len(first):
                size = stop - first
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), tokens.take(pa.array(ranges(first, size))))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(text[first])), pc.binary_join(lists, b" ").cast(pa.string()), pa.array(own, pa.int32())], names=["lang", "chunk", "own"])

    parsed = rows.mapInArrow(run, "lang string, chunk string, own int")
    return keep(parsed.groupBy("lang", "chunk", "own").agg(F.count("*").alias("freq")), "chunks")


def word_hash(lang: np.ndarray, word: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(lang * np.uint64(0x9E3779B97F4A7C15) + word)


def longer_hash(phrase: np.ndarray, word: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(phrase * np.uint64(0xD6E8FEB86659FD93) + word)


def digests(values: pa.Array) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w) for w in values.cast(pa.binary()).to_pylist()], np.uint64)


def has(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    place = h % np.uint64(BITS)
    return (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) > 0


def distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each key among the distinct ones, a place of each distinct one)."""
    of, keys = pd.factorize(key)
    place = np.zeros(len(keys), np.int64)
    place[of] = np.arange(len(key))
    return of, place


def count_block(lang: pa.Array, chunk: pa.Array, own: np.ndarray, freq: np.ndarray, sizes: Sequence[int], frequent: dict[int, np.ndarray], hashed_only: bool) -> list[tuple]:
    """(languages, phrases, weights) for each of `sizes`: the phrases that chunks of this block own, of that many words,
    that are frequent together with all their parts as far as `frequent` knows them; (hashes, weights) if `hashed_only`. Keys
    are numbers of words and shorter phrases, so the counts are exact; hashes only ask the filters. Size 0 is the empty
    phrase: all words."""
    lists = pc.split_pattern(chunk, " ")
    tokens, row = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets -= offsets[0]
    place = np.arange(len(row)) - offsets[:-1][row]
    owned, weight = place < own[row], freq[row]
    coded, langs = tokens.dictionary_encode(), lang.dictionary_encode()
    code, of_lang = coded.indices.to_numpy().astype(np.int64), langs.indices.to_numpy().astype(np.int64)[row]
    word = pc.not_equal(tokens, END.decode()).to_numpy(zero_copy_only=False)
    hashed, words = digests(coded.dictionary), len(coded.dictionary)
    # The bytes of a phrase are a slice of its chunk, as blanks join the tokens.
    size = pc.binary_length(tokens).to_numpy().astype(np.int64)
    data = np.frombuffer(pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(chunk)], pa.int32()), chunk), " ")[0].as_buffer(), np.uint8)
    start = np.cumsum(size + 1) - size - 1
    out = []
    if 0 in sizes:
        total = np.zeros(len(langs.dictionary), np.int64)
        np.add.at(total, of_lang[word & owned], weight[word & owned])
        out.append((langs.dictionary, pa.array([""] * len(total), pa.string()), pa.array(total)))
    at = np.flatnonzero(word)  # places where a phrase of the present size starts
    number, first = distinct(of_lang[at] * words + code[at])
    h = word_hash(digests(langs.dictionary)[of_lang[at[first]]], hashed[code[at[first]]])
    for n in range(1, max(sizes) + 1):
        if n > 1:
            # A longer phrase starts where one starts here and at the next place of the same chunk.
            dense = np.full(len(row) + 1, -1, np.int64)
            dense[at] = number
            both = dense[at + 1] >= 0
            both &= row[at] == row[np.minimum(at + n - 1, len(row) - 1)]
            at, before = at[both], number[both]
            number, first = distinct(before * words + code[at + n - 1])
            h = longer_hash(h[before[first]], hashed[code[at[first] + n - 1]])
        if n in frequent:
            good = has(frequent[n], h)[number]
            at, number = at[good], number[good]
        if not len(at):
            break
        if n in sizes:
            mine = owned[at]
            total, first = np.zeros(len(h), np.int64), np.full(len(h), -1, np.int64)
            np.add.at(total, number[mine], weight[at[mine]])
            first[number[mine]] = at[mine]
            some = np.flatnonzero(first >= 0)
            if hashed_only:
                out.append((pa.array((h[some] % np.uint64(HASHES)).astype(np.int64)), pa.array(total[some])))
                continue
            place = first[some]
            length = start[place + n - 1] + size[place + n - 1] - start[place]
            body = data[ranges(start[place], length)]
            phrases = pa.StringArray.from_buffers(len(place), pa.py_buffer(np.append(0, np.cumsum(length)).astype(np.int32)), pa.py_buffer(body))
            out.append((langs.dictionary.take(pa.array(of_lang[place])), phrases, pa.array(total[some])))
    return out


def _count(chunks: DataFrame, sizes: Sequence[int], frequent: dict[int, np.ndarray], schema: str, hashed_only: bool = False) -> DataFrame:
    """The rows of `count_block` for blocks of about BLOCK bytes of a chunk dictionary."""
    shared = chunks.sparkSession.sparkContext.broadcast(frequent)
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def done() -> Iterator[pa.RecordBatch]:
            block = pa.Table.from_batches(held).combine_chunks()
            columns = [block.column(k).chunk(0) for k in range(4)]
            for made in count_block(columns[0], columns[1], columns[2].to_numpy(), columns[3].to_numpy(), sizes, shared.value, hashed_only):
                yield pa.RecordBatch.from_arrays(list(made), names=names)

        for part in slices(batches, 1, 1 << 20, BLOCK):
            held.append(part)
            size += part.column(1).nbytes
            if size >= BLOCK:
                yield from done()
                held, size = [], 0
        if held:
            yield from done()

    return chunks.select("lang", "chunk", "own", "freq").mapInArrow(run, schema)


def count_phrases(chunks: DataFrame, sizes: Sequence[int], frequent: dict[int, np.ndarray]) -> DataFrame:
    """(lang, phrase, f) of a chunk dictionary; `frequent` holds a filter for each size that must pass one."""
    return _count(chunks, sizes, frequent, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def _filter(hashes: DataFrame) -> np.ndarray:
    """Bits of the hashes `h`. What reaches the driver is the filter's fixed size, whatever the corpus."""
    place = F.pmod(F.col("h"), F.lit(BITS))
    slots = hashes.select(F.shiftright(place, 6).alias("slot"), F.expr(f"shiftleft(1L, cast(pmod(h, {BITS}) & 63 as int))").alias("bit"))
    rows = slots.groupBy("slot").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(BITS >> 6, np.int64)
    bits[rows.column("slot").to_numpy()] = rows.column("bits").to_numpy()
    return bits.view(np.uint64)


def word_filter(words: DataFrame) -> np.ndarray:
    """Filter of (lang, phrase) rows of one word. Other words may pass and are counted in vain; none is missed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = word_hash(digests(batch.column(0)), digests(batch.column(1)))
            yield pa.RecordBatch.from_arrays([pa.array((h % np.uint64(HASHES)).astype(np.int64))], names=["h"])

    return _filter(words.select("lang", "phrase").mapInArrow(run, "h long"))


def hash_filter(chunks: DataFrame, sizes: Sequence[int], frequent: dict[int, np.ndarray], least: int) -> np.ndarray:
    """Filter of the phrases of these sizes whose hashes occur `least` times: numbers are counted here, not phrases, as
    most phrases are rare and their text would be most of what is shuffled."""
    return _filter(_count(chunks, sizes, frequent, "h long, f long", True).groupBy("h").agg(F.sum("f").alias("f")).filter(F.col("f") >= least))


def frequent_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", s: Settings = Settings()) -> DataFrame:
    """(lang, phrase, words, f): all phrases of 1 to 4 words with s.least occurrences or more, and all words as phrase ''.

    Four passes over the chunk dictionary: words, hashes of pairs of frequent words, hashes of longer phrases of frequent
    pairs, then the text of the phrases that pass. No phrase is more frequent than its parts and no hash is rarer than a
    phrase that has it, so what is left out cannot be frequent, and every count is exact.
    """
    chunks = chunk_dictionary(docs, text, lang, s.every)

    def counted(sizes: Sequence[int], frequent: dict[int, np.ndarray]) -> DataFrame:
        counts = count_phrases(chunks, sizes, frequent).filter((F.col("f") >= s.least) | (F.col("phrase") == ""))
        return materialize(counts.select("lang", "phrase", F.when(F.col("phrase") == "", 0).otherwise(F.size(F.split("phrase", " "))).alias("words"), "f"), "phrases")

    words = counted((0, 1), {})
    frequent = {1: word_filter(words.filter("words = 1"))}
    frequent[2] = hash_filter(chunks, (2,), frequent, s.least)
    longer = hash_filter(chunks, range(3, LONGEST + 1), frequent, s.least)
    frequent |= dict.fromkeys(range(3, LONGEST + 1), longer)
    return words.unionByName(counted(range(2, LONGEST + 1), frequent))


def mine_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", s: Settings = Settings()) -> DataFrame:
    """lang, rank (from 1), phrase, a, l, r, n, score: per language (null: `und`) the s.top phrases of 2 to 4 words that
    hold together best.

    a, l, r count the phrase and the two parts of its weakest cut, score is floor(2000000 a / (l + r)), n counts all words
    of the language. A phrase with s.covered percent of its occurrences or more inside one longer phrase is dropped.
    Ties go to the more frequent phrase, then to the smaller in bytes. Null and empty texts have no words, a text of any
    length is parsed whole, repeated rows count each time, extra columns are ignored, an empty table gives no rows.
    """
    counts = frequent_phrases(docs, text, lang, s)
    wide = F.lit(1).cast("decimal(38,0)")
    phrases = counts.filter("words > 1").select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    cut = phrases.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    join = lambda first, size: F.array_join(F.slice("w", first, size), " ")
    cut = cut.select("lang", "phrase", "a", "k", join(F.lit(1), F.col("k")).alias("left"), join(F.col("k") + 1, F.size("w") - F.col("k")).alias("right"))
    known = counts.filter("words > 0")
    cut = cut.join(known.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cut = cut.join(known.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    score = F.expr("cast(2000000 * cast(a as decimal(28,0)) div (cast(l as decimal(28,0)) + r) as long)")
    scored = cut.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = phrases.filter(F.size("w") > 2).select("a", "lang", "w", F.explode(F.sequence(F.lit(2), F.size("w") - 1)).alias("size"))
    inner = inner.select("a", "lang", "w", "size", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("size") + 1)).alias("first"))
    inner = inner.select("lang", join(F.col("first"), F.col("size")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = scored.join(inner, ["lang", "phrase"], "left").filter(
        F.coalesce(F.col("longer") * wide * 100 < F.col("a") * wide * s.covered, F.lit(True))
    )
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    kept = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score", F.pmod(F.xxhash64("phrase"), F.lit(64)).alias("salt"))
    # Ranked in 64 parts of a language first, so that the last window holds at most 64 times s.top rows.
    best = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= s.top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= s.top)
    total = counts.filter("words = 0").select("lang", F.col("f").alias("n"))
    return best.join(F.broadcast(total), "lang").select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")
