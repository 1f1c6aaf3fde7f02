"""Fill-in-the-middle examples as piece tables.

A document is never copied to be rearranged. It is a list of descriptors (buffer, start, length) over two immutable
buffers: its own UTF-8 text and the sentinels. Cutting splits descriptors, an arrangement permutes the sections with
their sentinels, and the inverse permutation puts them back; text only comes into being where it is written.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import blank, packed, slices

TEXT, SENTINEL = 0, 1
#: Sections of a cut document and the sentinels, in the order of an example's slots.
PREFIX, MIDDLE, SUFFIX, P, S, M = range(6)
ARRANGEMENTS = {"psm": (P, PREFIX, S, SUFFIX, M, MIDDLE), "spm": (S, SUFFIX, P, PREFIX, M, MIDDLE)}
PIECES = "array<struct<buffer:int,start:int,length:int>>"


@dataclass(frozen=True)
class Rule:
    """sentinels: of prefix, suffix and middle, none a part of another or overlapping one. plain, spm: percent of the
    documents left plain, and of the rest that put the suffix first. seed: names the draw of a document."""

    sentinels: tuple[str, str, str] = ("<P>", "<S>", "<M>")
    plain: int = 10
    spm: int = 20
    seed: str = "1"

    @property
    def buffer(self) -> bytes:
        return "".join(self.sentinels).encode()

    def sentinel(self, k: int) -> tuple[int, int, int]:
        """Descriptor of the k-th sentinel."""
        sizes = [len(s.encode()) for s in self.sentinels]
        return SENTINEL, sum(sizes[:k]), sizes[k]


class PieceTable:
    """Descriptors over immutable buffers."""

    def __init__(self, buffers: Sequence[bytes], pieces: list[tuple[int, int, int]]):
        self.views, self.pieces = [memoryview(b) for b in buffers], pieces

    def cut(self, ends: Sequence[int]) -> list[PieceTable]:
        """Sections that end at these offsets of the content, in ascending order, and what follows."""
        sections, rest, at = [], list(reversed(self.pieces)), 0
        for end in ends:
            taken = []
            while at < end:
                buffer, start, length = rest.pop()
                part = min(length, end - at)
                taken.append((buffer, start, part))
                if part < length:
                    rest.append((buffer, start + part, length - part))
                at += part
            sections.append(self._of(taken))
        return [*sections, self._of(rest[::-1])]

    def _of(self, pieces: list[tuple[int, int, int]]) -> PieceTable:
        table = object.__new__(PieceTable)
        table.views, table.pieces = self.views, pieces
        return table

    def arrange(self, sections: Sequence[PieceTable], order: Sequence[int]) -> PieceTable:
        return self._of([p for k in order for p in sections[k].pieces])

    def chunks(self) -> Iterator[memoryview]:
        for buffer, start, length in self.pieces:
            yield self.views[buffer][start : start + length]

    def content(self) -> bytes:
        return b"".join(self.chunks())

    def sha256(self) -> str:
        """Of the content, streamed from the buffers descriptor by descriptor."""
        digest = hashlib.sha256()
        for chunk in self.chunks():
            digest.update(chunk)
        return digest.hexdigest()


def restore(output: bytes, form: str, rule: Rule) -> PieceTable:
    """The text of an example as descriptors over `output`, from the output and its form alone.

    The sentinels cannot occur in the sections, so their first occurrences cut the output into the permuted slots;
    the inverse permutation gives the sections in the order of the text.
    """
    whole = PieceTable([output], [(0, 0, len(output))])
    if form == "plain":
        return whole
    order, ends, at = ARRANGEMENTS[form], [], 0
    for slot in order[::2]:
        mark = rule.sentinels[slot - P].encode()
        at = output.index(mark, at)
        ends += [at, at + len(mark)]
        at += len(mark)
    sections = whole.cut(ends)[1:]  # before the first sentinel stands nothing
    inverse = [order.index(slot) for slot in (PREFIX, MIDDLE, SUFFIX)]
    return whole.arrange(sections, inverse)


def piece_tables(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rule: Rule = Rule()) -> DataFrame:
    """One row per row of `docs`: doc_id, text (null: empty), n (code points), form (plain, psm or spm), prefix_chars,
    middle_chars (null if plain) and pieces, the descriptors of the example in bytes of the text and of the sentinels.

    The draw of a document is the SHA-256 of the seed, a colon and the id in decimal (null: nothing), so equal ids are cut
    by the same numbers and any repeat gives the same example. Cuts count code points of the whole text, of any length;
    a document that is empty or contains a sentinel stays plain. Ties of both cuts give an empty middle. Repeated rows are rows of
    their own, extra columns are ignored, an empty table gives no rows. Expressions only, and no shuffle.
    """
    rows = packed(docs, doc_id, text).select(F.col(f"`{doc_id}`").alias("doc_id"), blank(text).alias("text"))
    rows = rows.withColumn("n", F.length("text").cast("long"))
    digest = F.sha2(F.concat(F.lit(f"{rule.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    draw = lambda k: F.conv(F.substring("digest", 8 * k + 1, 8), 16, 10).cast("long")
    rows = rows.withColumn("digest", digest).select("doc_id", "text", "n", *[draw(k).alias(f"h{k + 1}") for k in range(4)])
    held = F.lit(False)
    for mark in rule.sentinels:
        held = held | F.contains("text", F.lit(mark))
    plain = (F.col("n") == 0) | held | (F.col("h3") % 100 >= 100 - rule.plain)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < rule.spm, "spm").otherwise("psm")
    cut = [F.col(h) % (F.col("n") + 1) for h in ("h1", "h2")]
    rows = rows.select("doc_id", "text", "n", form.alias("form"), F.least(*cut).cast("int").alias("a"), F.greatest(*cut).cast("int").alias("b"))
    upto = lambda end: F.octet_length(F.substring("text", F.lit(1), F.col(end)))
    rows = rows.select("*", upto("a").alias("a8"), upto("b").alias("b8"), F.octet_length("text").alias("n8"))

    def piece(buffer: int, start: Column, length: Column) -> Column:
        return F.struct(F.lit(buffer).alias("buffer"), start.cast("int").alias("start"), length.cast("int").alias("length"))

    a, b, n = F.col("a8"), F.col("b8"), F.col("n8")
    slots = [piece(TEXT, F.lit(0), a), piece(TEXT, a, b - a), piece(TEXT, b, n - b)]
    slots += [piece(SENTINEL, F.lit(start), F.lit(length)) for _, start, length in map(rule.sentinel, range(3))]
    pieces = F.array(piece(TEXT, F.lit(0), n))
    for name, order in ARRANGEMENTS.items():
        pieces = F.when(F.col("form") == name, F.array(*[slots[k] for k in order])).otherwise(pieces)
    count = lambda c: F.when(F.col("form") != "plain", c.cast("long"))
    return rows.select("doc_id", "text", "n", "form", count(F.col("a")).alias("prefix_chars"), count(F.col("b") - F.col("a")).alias("middle_chars"), pieces.alias("pieces"))


def _each(tables: DataFrame, texts: str, make: Callable[..., tuple], columns: Sequence[str]) -> DataFrame:
    """Adds string columns, which `make` (bytes of column `texts`, form, and pieces if there) gives for each row."""
    place = tables.columns.index(texts)
    schema = ", ".join([f"`{n}` {t}" for n, t in tables.dtypes] + [f"`{n}` string" for n in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, place, 2000):
            names = part.schema.names
            inputs = [part.column(place).cast(pa.binary()), *[part.column(names.index(n)) for n in ("form", "pieces") if n in names]]
            made = zip(*(make(*row) for row in zip(*(c.to_pylist() for c in inputs))))
            yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(x, pa.binary()).cast(pa.string()) for x in made]], names=[*names, *columns])

    return tables.mapInArrow(run, schema)


def _table(text: bytes, pieces: list[dict], rule: Rule) -> PieceTable:
    return PieceTable([text, rule.buffer], [(p["buffer"], p["start"], p["length"]) for p in pieces])


def write_examples(tables: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """Rows of `piece_tables` with `output`, the text of the example."""
    return _each(tables, "text", lambda text, form, pieces: (_table(text, pieces, rule).content(),), ["output"])


def restore_texts(examples: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """Rows (form, output, ...) with `restored`, the text that the example was made of."""
    return _each(examples, "output", lambda output, form, *_: (restore(output, form, rule).content(),), ["restored"])


def digest_examples(tables: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """Rows of `piece_tables` with output_sha256, streamed from the descriptors, and restored_sha256, streamed from
    the inverse permutation of the written output."""

    def digests(text: bytes, form: str, pieces: list[dict]) -> tuple[str, str]:
        table = _table(text, pieces, rule)
        return table.sha256(), restore(table.content(), form, rule).sha256()

    return _each(tables, "text", digests, ["output_sha256", "restored_sha256"])
