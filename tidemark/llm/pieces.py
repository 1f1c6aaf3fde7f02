"""SentencePiece BPE encoding with the byte span of every piece, and decoding."""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm.frames import blank, packed, slices

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # fixed values of the model format
CACHED_UNITS, SHORT_UNIT = 200_000, 96
NO_PAIR = 1 << 30


class CharMap:
    """Compiled character map of a model: a double-array trie of source strings and their replacements."""

    def __init__(self, blob: bytes):
        self.units, self.texts = (), b""
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
            self.texts = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[str, int] | None:
        """Replacement of the longest source string that starts at `at`, and that string's length."""
        units, found = self.units, None
        if not units:
            return None
        unit = units[0]
        node = (unit >> 10) << ((unit & 512) >> 6)
        for k in range(at, len(data)):
            node ^= data[k]
            unit = units[node]
            if unit & 0x800000FF != data[k]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                found = units[node] & 0x7FFFFFFF, k + 1 - at
        if found is None:
            return None
        start = found[0]
        return self.texts[start : self.texts.index(b"\0", start)].decode(), found[1]

    def normalise(self, text: str, dummy: bool, squeeze: bool) -> tuple[str, np.ndarray]:
        """Normalised text with visible spaces, and for each of its characters and its end the source byte.

        dummy: a space is put before the text. squeeze: leading, trailing and repeated spaces go.
        """
        if not self.units and not squeeze:
            data = np.frombuffer(text.encode(), np.uint8)
            starts = np.flatnonzero((data & 0xC0) != 0x80)
            if not len(data):
                return "", np.zeros(1, np.int64)
            lead = [0] if dummy else []
            return SPACE * dummy + text.replace(" ", SPACE), np.concatenate([lead, starts, [len(data)]]).astype(np.int64)
        data, at, out, source = text.encode(), 0, [], []
        before_space = squeeze
        while at < len(data):
            got = self.longest(data, at)
            if got is None:
                width = 1 if data[at] < 0x80 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
                got = data[at : at + width].decode(), width
            piece = got[0]
            if before_space:
                piece = piece.lstrip(" ")
            if piece and not source and dummy:
                out.append(SPACE)
                source.append(at if squeeze else 0)
            out.append(piece.replace(" ", SPACE))
            source.extend([at] * len(piece))
            if piece or not squeeze:
                before_space = squeeze and piece.endswith(" ")
            at += got[1]
        if squeeze:
            joined = "".join(out)
            cut = len(joined.rstrip(SPACE))
            end = source[cut] if cut < len(joined) else at if joined else 0
            return joined[:cut], np.array(source[:cut] + [end], np.int64)
        return "".join(out), np.array(source + [at], np.int64)


class PieceModel:
    """A BPE model with byte fallback: merges by score, ties to the left."""

    def __init__(self, blob: bytes):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        model.ParseFromString(blob)
        kinds = {p.type for p in model.pieces}
        if model.trainer_spec.model_type != 2 or kinds & {USER, UNUSED} or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only BPE models without user-defined or unused pieces are supported")
        spec = model.normalizer_spec
        self.map, self.dummy, self.squeeze = CharMap(spec.precompiled_charsmap), spec.add_dummy_prefix, spec.remove_extra_whitespaces
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.scores = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == UNKNOWN)
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.surface = [b"" if p.type == CONTROL else " ⁇ ".encode() if p.type == UNKNOWN else bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else p.piece.replace(SPACE, " ").encode() for p in model.pieces]
        self.control = {i for i, p in enumerate(model.pieces) if p.type == CONTROL}
        self.byte_ids = set(self.bytes.values())
        # If no piece has a space after another character, no merge crosses the start of a space run.
        crossing = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.unit = re.compile("[\\s\\S]+" if crossing else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        self._build_pairs()
        self._forget()
        self.byte_table = np.frombuffer(b"".join(self.surface), np.uint8)
        self.byte_size = np.array([len(x) for x in self.surface], np.int64)
        self.byte_start = np.cumsum(self.byte_size) - self.byte_size
        self.plain = np.array([p.type == NORMAL for p in model.pieces])
        self.spaced = np.array([p.piece.startswith(SPACE) for p in model.pieces])

    def _build_pairs(self) -> None:
        """Arrays for merging many units at once: symbols of characters, and a hash table of mergeable pairs."""
        strings = dict.fromkeys(self.ids) | dict.fromkeys(c for p in self.ids for c in p)
        number = {p: k for k, p in enumerate(strings)}
        self.none = len(number)  # the symbol of every character no piece has
        self.char_symbol = np.full(0x110000, self.none, np.int32)
        for p, k in number.items():
            if len(p) == 1:
                self.char_symbol[ord(p)] = k
        self.symbol_id = np.array([self.ids.get(p, -1) for p in number] + [-1], np.int32)
        self.symbol_chars = np.array([len(p) for p in number] + [1], np.int32)
        rank = {score: k for k, score in enumerate(sorted(set(self.scores.values()), reverse=True))}
        found = [(number[p[:k]] * (self.none + 1) + number[p[k:]], rank[self.scores[p]], number[p]) for p in self.ids for k in range(1, len(p)) if p[:k] in number and p[k:] in number]
        keys, ranks, merged = (np.array(x, np.int64) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
        self.table_bits = max(4, int(len(keys)).bit_length() + 3)
        self.table = np.full((1 << self.table_bits) + 1, -1, np.int64)
        self.table_rank, self.table_merged = np.full(len(self.table), NO_PAIR, np.int32), np.zeros(len(self.table), np.int32)
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.table[at[left]] == -1
            _, first = np.unique(at[left[free]], return_index=True)
            put = left[free][first]
            self.table[at[put]], self.table_rank[at[put]], self.table_merged[at[put]] = keys[put], ranks[put], merged[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            at[left] = (at[left] + 1) & ((1 << self.table_bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.table_bits)).astype(np.int64)

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (the smaller is merged first) and merged symbol of each pair."""
        keys = a.astype(np.int64) * (self.none + 1) + b
        at = self._slot(keys)
        got = self.table[at]
        open_ = np.flatnonzero((got != keys) & (got != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.table_bits) - 1)
            got = self.table[at[open_]]
            open_ = open_[(got != keys[open_]) & (got != -1)]
        return self.table_rank[at], self.table_merged[at]

    def merge_all(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(unit of each symbol, symbols), all units merged side by side, one pair of each a round."""
        symbols = self.char_symbol[np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)]
        unit = np.repeat(np.arange(len(units)), np.fromiter(map(len, units), np.int64, len(units)))

        def ranked(places: np.ndarray) -> None:
            """Look up the pairs that start at these places; none at the end of a unit."""
            inner = places[(places + 1 < len(unit))]
            inner = inner[unit[inner + 1] == unit[inner]]
            rank[places] = NO_PAIR
            rank[inner], merged[inner] = self._pairs(symbols[inner], symbols[inner + 1])

        rank, merged = np.empty(len(symbols), np.int32), np.zeros(len(symbols), np.int32)
        ranked(np.arange(len(symbols)))
        ended: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            starts = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
            best = np.repeat(np.minimum.reduceat(rank, starts), np.diff(starts, append=len(symbols)))
            over = best == NO_PAIR
            if over.any():
                ended.append((unit[over], symbols[over]))
                unit, symbols, rank, merged, best = unit[~over], symbols[~over], rank[~over], merged[~over], best[~over]
                if not len(symbols):
                    break
            hits = np.flatnonzero(rank == best)
            hits = hits[np.concatenate([[True], unit[hits[1:]] != unit[hits[:-1]]])]  # ties to the left
            symbols[hits] = merged[hits]
            stay = np.ones(len(symbols), bool)
            stay[hits + 1] = False
            unit, symbols, rank, merged = unit[stay], symbols[stay], rank[stay], merged[stay]
            hits = hits - np.arange(len(hits))
            before = hits[hits > 0] - 1
            ranked(hits)
            ranked(before[unit[before] == unit[before + 1]])
        if not ended:
            return unit, symbols
        unit, symbols = (np.concatenate(x) for x in zip(*ended))
        order = np.argsort(unit, kind="stable")
        return unit[order], symbols[order]

    def merge(self, unit: str) -> list[str]:
        """The pieces of a unit by a heap of pairs and a linked list, near linear for long units."""
        scores = self.scores
        symbols: list[str] = list(unit)
        last = len(symbols) - 1
        following, previous = list(range(1, last + 2)), list(range(-1, last))
        heap = [(-scores[pair], k, pair) for k in range(last) if (pair := symbols[k] + symbols[k + 1]) in scores]
        heapq.heapify(heap)
        while heap:
            _, k, pair = heapq.heappop(heap)
            after = following[k]
            if not symbols[k] or after > last or symbols[k] + symbols[after] != pair or not symbols[after]:
                continue
            symbols[k], symbols[after] = pair, ""
            nxt = following[k] = following[after]
            if nxt <= last:
                previous[nxt] = k
                if (joined := pair + symbols[nxt]) in scores:
                    heapq.heappush(heap, (-scores[joined], k, joined))
            if (back := previous[k]) >= 0 and (joined := symbols[back] + pair) in scores:
                heapq.heappush(heap, (-scores[joined], back, joined))
        return [s for s in symbols if s]

    def encode_unit(self, unit: str) -> tuple[tuple[int, ...], tuple[int, ...]]:
        """Ids and, for each, its characters of the unit; of a byte run only the last has its character."""
        pieces = self.merge(unit)
        known = tuple(map(self.ids.get, pieces))
        if None not in known:
            return known, tuple(map(len, pieces))
        ids, chars = [], []
        for piece, i in zip(pieces, known):
            if i is not None:
                ids.append(i)
                chars.append(len(piece))
            elif self.bytes:
                data = piece.encode()
                ids.extend(self.bytes[b] for b in data)
                chars.extend([0] * (len(data) - 1) + [1])
            else:
                ids.append(self.unknown)
                chars.append(len(piece))
        return tuple(ids), tuple(chars)

    def _learn_units(self, units: set[str]) -> None:
        """Put units into the cache: where each one's ids are in the flat arrays, and how many."""
        plain = [u for u in units if len(u) <= SHORT_UNIT]
        of, symbols = self.merge_all(plain)
        ids, chars = self.symbol_id[symbols], self.symbol_chars[symbols]
        counts = np.bincount(of, minlength=len(plain))
        odd = {*np.unique(of[ids < 0]).tolist()}  # a character without a piece, given as bytes
        stop = self.filled + np.cumsum(counts)
        parts, at = [(ids, chars, counts)], self.filled + len(ids)
        names = plain
        rest = [u for u in units if len(u) > SHORT_UNIT] + [plain[k] for k in odd]
        for u in rest:
            found = self.encode_unit(u)
            parts.append((np.array(found[0], np.int32), np.array(found[1], np.int32), None))
        base = len(self.starts)
        self.cache.update((u, base + k) for k, u in enumerate(names))
        starts, sizes = [stop - counts], [counts]
        for k, (u, part) in enumerate(zip(rest, parts[1:])):
            self.cache[u] = base + len(names) + k
            starts.append(np.array([at]))
            sizes.append(np.array([len(part[0])]))
            at += len(part[0])
        self.flat_ids = np.concatenate([self.flat_ids, *[p[0] for p in parts]])
        self.flat_chars = np.concatenate([self.flat_chars, *[p[1] for p in parts]])
        self.starts, self.sizes = np.concatenate([self.starts, *starts]), np.concatenate([self.sizes, *sizes])
        self.filled = len(self.flat_ids)

    def _forget(self) -> None:
        self.cache, self.filled = {}, 0
        self.flat_ids, self.flat_chars = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts in a row, first and end source byte of each, and where each text's ids end."""
        normal, sources = zip(*(self.map.normalise(t, self.dummy, self.squeeze) for t in texts)) if texts else ((), ())
        split = [self.unit.findall(t) for t in normal]
        units = list(chain.from_iterable(split))
        wanted = {*units}
        missing = wanted - self.cache.keys()
        if len(self.cache) + len(missing) > CACHED_UNITS:  # begin anew with all of these, even if they alone are more
            self._forget()
            missing = wanted
        if missing:
            self._learn_units(missing)
        row = np.fromiter(map(self.cache.__getitem__, units), np.int64, len(units))
        counts = self.sizes[row]
        ends = np.concatenate([[0], np.cumsum(counts)])
        place = np.arange(ends[-1]) + np.repeat(self.starts[row] - ends[:-1], counts)
        ids, chars = self.flat_ids[place], self.flat_chars[place].astype(np.int64)
        stop = ends[np.cumsum([0] + [len(x) for x in split])]
        # Characters before each text, in the texts' joined source maps, which have one entry more per text.
        at = np.concatenate([[0], np.cumsum(chars)])
        shift = np.cumsum([0] + [len(x) for x in sources])[:-1] - at[stop[:-1]]
        shift = np.repeat(shift, np.diff(stop))
        source = np.concatenate(sources) if sources else np.zeros(0, np.int64)
        return ids, source[at[:-1] + shift], source[at[1:] + shift], stop

    def encode(self, text: str) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Ids, and first and end source byte of each piece."""
        ids, first, end, _ = self.encode_all([text])
        return ids.tolist(), first, end

    def decode(self, ids: list[int]) -> str:
        surface = self.surface
        if not self.control.isdisjoint(ids):  # control ids have no text, but bytes do not join across them
            runs: list[list[int]] = [[]]
            for i in ids:
                runs[-1].append(i) if i not in self.control else runs.append([])
            runs = [r for r in runs if r]
            return "".join(self._decode_run(r, k == 0) for k, r in enumerate(runs))
        return self._decode_run(ids, True) if ids else ""

    def decode_all(self, ids: np.ndarray, stop: np.ndarray) -> pa.Array:
        """Texts of many id lists, given in a row with the ends of each; lists with other than normal pieces by `decode`."""
        sizes = self.byte_size[ids]
        at = np.concatenate([[0], np.cumsum(sizes)])
        lengths = np.diff(stop)
        data = self.byte_table[np.arange(at[-1]) + np.repeat(self.byte_start[ids] - at[:-1], sizes)]
        begin, end = at[stop[:-1]], at[stop[1:]]
        odd = np.zeros(len(lengths), bool) if self.squeeze is False else np.ones(len(lengths), bool)
        strange = np.flatnonzero(~self.plain[ids])
        odd[np.searchsorted(stop, strange, "right") - 1] = True
        if self.dummy:
            lead = np.flatnonzero(lengths > 0)
            begin[lead] += self.spaced[ids[stop[:-1][lead]]]
        joined = data.tobytes()
        return pa.array([self.decode(ids[stop[k] : stop[k + 1]].tolist()) if odd[k] else joined[begin[k] : end[k]].decode() for k in range(len(lengths))], pa.string())

    def _decode_run(self, ids: list[int], leads: bool) -> str:
        surface, lead = self.surface, 0
        data = b"".join([surface[i] for i in ids])
        if leads and (self.dummy or self.squeeze) and ids[lead] != self.unknown and ids[lead] not in self.byte_ids and data.startswith(b" "):
            first = surface[ids[lead]]
            data = data[len(first) - len(first.lstrip(b" ")) :] if self.squeeze else data[1:]
        try:
            return data.decode()
        except UnicodeDecodeError:  # ids that no text gives: each byte of a broken run by itself
            return "".join(c if not "\udc80" <= c <= "\udcff" else "�" for c in data.decode(errors="surrogateescape"))


def encode_texts(docs: DataFrame, model_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, ids, starts, ends (arrays of equal length; bytes of the UTF-8 text).

    Null texts are empty and have no ids; rows that repeat each have a row; an empty table gives no rows; extra
    columns are ignored. `model_path` is read on the driver and broadcast: its size is that of the vocabulary.
    Each task keeps a bounded cache of the units between spaces it has merged.
    """
    blob = docs.sparkSession.sparkContext.broadcast(open(model_path, "rb").read())
    rows = packed(docs, doc_id, text).select(f"`{doc_id}`", blank(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = PieceModel(blob.value)
        for batch in slices(batches, 1, 192):
            *flat, stop = model.encode_all(batch.column(1).to_pylist())
            columns = [pa.ListArray.from_arrays(pa.array(stop, pa.int32()), pa.array(x, pa.int32())) for x in flat]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[doc_id, "ids", "starts", "ends"])

    numbers = T.ArrayType(T.IntegerType(), False)
    schema = T.StructType([rows.schema[0], *(T.StructField(n, numbers) for n in ("ids", "starts", "ends"))])
    return rows.mapInArrow(run, schema)


def decode_ids(coded: DataFrame, model_path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """All columns of `coded` and `into`, the text of the ids; null ids are none."""
    blob = coded.sparkSession.sparkContext.broadcast(open(model_path, "rb").read())
    at = coded.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = PieceModel(blob.value)
        for batch in (b.slice(k, 192) for b in batches for k in range(0, b.num_rows, 192)):
            lists = batch.column(at).fill_null([]) if batch.column(at).null_count else batch.column(at)
            stop = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            texts = model.decode_all(lists.flatten().to_numpy(zero_copy_only=False), stop)
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*batch.schema.names, into])

    return coded.mapInArrow(run, T.StructType([*coded.schema, T.StructField(into, T.StringType())]))
