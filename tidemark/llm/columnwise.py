"""Burrows-Wheeler transform and common prefixes of a collection of strings, built column by column.

Each round puts one more symbol in front of every string's last suffix: the symbol goes where that suffix stands
in the transform, and the longer suffix is inserted where the counts of equal symbols before it say. The
length of the prefix it shares with its neighbours is one more than the least common prefix between
their tails. Every round reads the two files once from front to back and writes the next two.
"""

from __future__ import annotations

import tempfile

import numpy as np

FAR = 32767
BLOCK = 1 << 20
IN_MEMORY = 1 << 22


def _column(size: int, kind: type) -> np.ndarray:
    """An array; a temporary file beyond IN_MEMORY entries, gone with its last user."""
    if size <= IN_MEMORY:
        return np.empty(size, kind)
    return np.memmap(tempfile.TemporaryFile(), kind, "w+", shape=(size,))


class RangeMinimum:
    """Least value of any range of an array: doubled windows up to 32, and of whole blocks of 32."""

    def __init__(self, values: np.ndarray):
        self.small = [values]
        for k in range(5):
            last = self.small[-1]
            self.small.append(np.minimum(last[: -(1 << k)], last[1 << k :]) if len(last) > 1 << k else last[:0])
        whole = len(values) // 32
        self.large = [values[: whole * 32].reshape(whole, 32).min(1)] if whole else [values[:0]]
        while len(self.large[-1]) > 1 << (len(self.large) - 1):
            last, k = self.large[-1], len(self.large) - 1
            self.large.append(np.minimum(last[: -(1 << k)], last[1 << k :]))

    def __call__(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Least of values[first:end]; FAR for empty ranges."""
        out = np.full(len(first), FAR, np.int16)
        size = end - first
        for k in range(6):
            pick = np.flatnonzero((size >= 1 << k) & ((size < 2 << k) if k < 5 else True))
            if len(pick):
                level = self.small[k]
                out[pick] = np.minimum(level[first[pick]], level[end[pick] - (1 << k)])
        a, b = -(-first // 32), end // 32
        span = b - a
        for k in range(len(self.large)):
            pick = np.flatnonzero((size >= 32) & (span >= 1 << k) & (span < 2 << k))
            if len(pick):
                level = self.large[k]
                out[pick] = np.minimum(out[pick], np.minimum(level[a[pick]], level[b[pick] - (1 << k)]))
        return out


def build(strings: list[np.ndarray], alphabet: int, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(transform, common prefix of each suffix with the one before) of all suffixes of the strings, empty ones first.

    Symbols are 0 .. alphabet-1; `alphabet` stands in the transform where a string begins. Suffixes that are
    equal stand in the order of their strings. Common prefixes never pass a string's end.
    """
    kind = np.uint16 if alphabet < 65535 else np.uint32
    count, letters = len(strings), alphabet + 1
    lengths = np.array([len(s) for s in strings], np.int64)
    text = np.concatenate([*strings, np.zeros(0, kind)]).astype(kind)
    ends = np.cumsum(lengths)
    bwt, lcp = _column(count, kind), _column(count, np.int16)
    bwt[:], lcp[:] = alphabet, 0
    place = np.arange(count)  # of each string's longest suffix so far
    totals, fresh = np.zeros(letters, np.int64), np.zeros(letters, bool)
    for turn in range(1, int(lengths.max(initial=0)) + 1):
        live = np.flatnonzero(lengths >= turn)
        live = live[np.argsort(place[live])]
        at, symbol = place[live], text[ends[live] - turn]
        totals += np.bincount(symbol, minlength=letters)
        first_row = count + np.cumsum(totals) - totals
        row, shared = np.empty(len(live), np.int64), np.empty(len(live), np.int64)
        after = np.full(len(live), -1, np.int64)  # common prefix of the suffix after, if it starts with the same symbol
        late: list[np.ndarray] = []
        single = len(bwt) <= block
        if not single:  # what blocks leave to the next: per symbol its count, the least common prefix since its last, its row if new
            seen, least, new_last = np.zeros(letters, np.int64), np.full(letters, FAR, np.int64), np.full(letters, -1, np.int64)
        for begin in range(0, len(bwt), block):
            lo, hi = np.searchsorted(at, [begin, begin + block])
            here, letter = at[lo:hi] - begin, symbol[lo:hi]
            bwt[at[lo:hi]] = letter
            part, common = np.asarray(bwt[begin : begin + block]), np.asarray(lcp[begin : begin + block])
            # The block's entries by symbol; in one block only those of new symbols matter.
            if single:
                fresh[letter] = True
                order = np.flatnonzero(fresh[part])
                fresh[letter] = False
                order = order[np.argsort(part[order], kind="stable")]
            else:
                order = np.argsort(part, kind="stable")
            by_symbol = part[order]
            minimum = RangeMinimum(common)
            rank = np.empty(len(part), np.int32)
            rank[order] = np.arange(len(order), dtype=np.int32)
            # Each new symbol's number among its equals, and the equals before and after it.
            k = rank[here]
            number = k - np.searchsorted(by_symbol, letter)
            head, more = number == 0, (k + 1 < len(order)) & (by_symbol.take(k + 1, mode="clip") == letter)
            before = np.where(head, 0, order[k - 1] + 1)
            value = minimum(before, here + 1).astype(np.int64) + 1
            follow = order.take(k + 1, mode="clip")
            after[lo:hi][more] = minimum(here[more] + 1, follow[more] + 1).astype(np.int64) + 1
            row[lo:hi] = first_row[letter] + number
            shared[lo:hi] = np.where(head, 0, value)
            if single:
                continue
            row[lo:hi] += seen[letter]
            shared[lo:hi] = np.where(head & (seen[letter] > 0), np.minimum(value, least[letter] + 1), shared[lo:hi])
            sizes = np.bincount(part, minlength=letters)
            starts = np.cumsum(sizes) - sizes
            present = np.flatnonzero(sizes[:alphabet])
            due = present[new_last[present] >= 0]  # the first of these follows what an earlier block ended with
            first = order[starts[due]]
            late.append(np.stack([new_last[due] + 1, np.minimum(minimum(first * 0, first + 1), least[due]) + 1]))
            last = order[starts[present] + sizes[present] - 1]
            least[sizes[:letters] == 0] = np.minimum(least[sizes[:letters] == 0], common.min())
            least[present] = minimum(last + 1, last * 0 + len(part))
            new_last[present] = -1
            ending = ~more
            new_last[letter[ending]] = row[lo:hi][ending]
            seen += sizes
        size = len(bwt) + len(live)
        rows = np.sort(row)
        change, values = np.concatenate([*(x[0] for x in late), row[after >= 0] + 1, row]), np.concatenate([*(x[1] for x in late), after[after >= 0], shared])
        new_bwt, new_lcp = _column(size, kind), _column(size, np.int16)
        taken = 0
        for begin in range(0, size, block):
            stop = min(size, begin + block)
            lo, hi = np.searchsorted(rows, [begin, stop])
            old = np.ones(stop - begin, bool)
            old[rows[lo:hi] - begin] = False
            kept = stop - begin - (hi - lo)
            out_bwt, out_lcp = np.full(stop - begin, alphabet, kind), np.zeros(stop - begin, np.int16)
            out_bwt[old], out_lcp[old] = bwt[taken : taken + kept], lcp[taken : taken + kept]
            taken += kept
            new_bwt[begin:stop], new_lcp[begin:stop] = out_bwt, out_lcp
        new_lcp[change] = values
        bwt, lcp = new_bwt, new_lcp
        place[live] = row
    return bwt, lcp


def repeats(strings: list[np.ndarray], alphabet: int, width: int, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(string, start) of every substring of `width` symbols that starts elsewhere in the collection too."""
    bwt, lcp = build(strings, alphabet, block)
    high = np.asarray(lcp) >= width
    again = high.copy()
    again[:-1] |= high[1:]
    # From a suffix's row to that of the suffix one symbol longer.
    letters = alphabet + 1
    longer, seen, totals = _column(len(bwt), np.int64), np.zeros(letters, np.int64), np.zeros(letters, np.int64)
    for begin in range(0, len(bwt), block):
        totals += np.bincount(bwt[begin : begin + block], minlength=letters)
    first_row = len(strings) + np.cumsum(totals) - totals
    for begin in range(0, len(bwt), block):
        part = np.asarray(bwt[begin : begin + block])
        order, sizes = np.argsort(part, kind="stable"), np.bincount(part, minlength=letters)
        row = np.empty(len(part), np.int64)
        row[order] = np.arange(len(part)) + np.repeat(first_row + seen - (np.cumsum(sizes) - sizes), sizes)
        longer[begin : begin + len(part)] = row
        seen += sizes
    lengths = np.array([len(s) for s in strings], np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    live, row = np.arange(len(strings)), np.arange(len(strings))
    for size in range(1, int(lengths.max(initial=0)) + 1):
        stay = lengths[live] >= size
        live, row = live[stay], longer[row[stay]]
        if size >= width:
            hit = again[row]
            found.append((live[hit], lengths[live[hit]] - size))
    return tuple(np.concatenate(x) for x in zip(*found))


def repeated_starts(strings: list[bytes], width: int, unit: int = 8, block: int = BLOCK) -> list[np.ndarray]:
    """For each string the starts of its substrings of `width` bytes that start elsewhere in the strings too.

    A symbol is a run of `unit` bytes, which must divide `width`. Each string enters once for each of the `unit`
    phases, so that a substring at any byte is a run of symbols in one of them; rounds and steps shrink by `unit`.
    """
    assert width % unit == 0
    phases = [np.frombuffer(s, np.uint8)[f : f + (len(s) - f) // unit * unit].reshape(-1, unit) if len(s) >= f else np.zeros((0, unit), np.uint8) for s in strings for f in range(unit)]
    powers = np.uint64(256) ** np.arange(unit, dtype=np.uint64)
    sizes = [len(p) for p in phases]
    names, symbols = np.unique((np.concatenate([*phases, np.zeros((0, unit), np.uint8)]) * powers).sum(1, dtype=np.uint64), return_inverse=True)
    string, start = repeats(np.split(symbols, np.cumsum(sizes)[:-1]), len(names), width // unit, block)
    string, start = string // unit, start * unit + string % unit
    order = np.lexsort((start, string))
    return np.split(start[order], np.searchsorted(string[order], np.arange(1, len(strings))))
