"""ProbMinHash of weighted shingles: each shingle arrives in a Poisson process at the rate of its weight."""

from __future__ import annotations

import numpy as np
import xxhash

MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))  # fixed values: splitmix64
CACHED_WORDS = 40_000


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 of unsigned 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * MIX[1]
        x = (x ^ (x >> np.uint64(27))) * MIX[2]
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, kept for the commonest."""

    def __missing__(self, word: str) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < CACHED_WORDS:
            self[word] = value
        return value


def shingles(text: str, words: int, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of runs of `words` words, and how often each occurs.

    Words are what white space separates. A text of fewer words is one shingle, one without words has none.
    """
    parts = text.split()
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.array(list(map(hashes.__getitem__, parts)), np.uint64)
    width = min(words, len(parts))
    n = len(parts) - width + 1
    with np.errstate(over="ignore"):
        run = np.full(n, width, np.uint64)
        for k in range(width):
            run = mix(run + h[k : k + n] + MIX[0])
    return np.unique(run, return_counts=True)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard of two weighted sets; plain Jaccard if every weight is 1. Two empty sets are equal."""
    (ea, wa), (eb, wb) = a, b
    if not len(ea) or not len(eb):
        return float(len(ea) == len(eb))
    place = np.searchsorted(eb, ea)
    place[place == len(eb)] = 0
    both = eb[place] == ea
    common = int(both.sum())
    if wa[-1] == 1 and wb[-1] == 1 and wa.max() == 1 and wb.max() == 1:
        return common / (len(ea) + len(eb) - common)
    if not common:
        return 0.0
    x, y = wa[both].astype(float), wb[place[both]].astype(float)
    only_a, only_b = wa.sum() - x.sum(), wb.sum() - y.sum()
    # Sum over j of max(x_j / x_i, y_j / y_i): x counts where x_j / y_j is at least x_i / y_i, y elsewhere.
    order = np.argsort(x / y, kind="stable")
    x, y = x[order], y[order]
    ratio = x / y
    first = np.searchsorted(ratio, ratio, "left")
    above = only_a + np.concatenate([np.cumsum(x[::-1])[::-1], [0]])[first]
    below = only_b + np.concatenate([[0], np.cumsum(y)])[first]
    return float((1 / (above / x + below / y)).sum())


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], registers: int) -> np.ndarray:
    """For each set and register the shingle that arrives there first; 0 for an empty set.

    All sets advance together, arrival by arrival. A shingle ends as soon as its time passes the latest of
    its set's registers (early termination): all its later arrivals would come too late.
    """
    won = np.zeros((len(sets), registers), np.uint64)
    live = [k for k, s in enumerate(sets) if len(s[0]) > 1]
    for k, s in enumerate(sets):
        if len(s[0]) == 1:
            won[k] = s[0][0]
    if not live:
        return won
    element = np.concatenate([sets[k][0] for k in live])
    rate = np.concatenate([sets[k][1] / sets[k][1].sum() for k in live])
    owner = np.repeat(np.arange(len(live)), [len(sets[k][0]) for k in live])
    times, winner = np.full((len(live), registers), np.inf), np.zeros((len(live), registers), np.uint64)
    clock, arrivals, turn = np.zeros(len(element)), 0, 0
    flat_times, flat_winner = times.reshape(-1), winner.reshape(-1)
    while len(element):
        many = min(16, 1 << (turn // 2))
        turn += 1
        for _ in range(many):
            arrivals += 1
            with np.errstate(over="ignore"):
                draw = mix(element + MIX[0] * np.uint64(arrivals))
            clock = clock - np.log(((draw >> np.uint64(11)).astype(float) + 1) * 2.0**-53) / rate
            slot = owner * registers + (mix(draw ^ MIX[2]) % np.uint64(registers)).astype(np.int64)
            early = clock < flat_times[slot]
            at, when = slot[early], clock[early]
            np.minimum.at(flat_times, at, when)
            first = flat_times[at] == when
            flat_winner[at[first]] = element[early][first]
        keep = clock < times.max(axis=1)[owner]
        element, rate, owner, clock = element[keep], rate[keep], owner[keep], clock[keep]
    won[live] = winner
    return won


def bands(won: np.ndarray, rows: int) -> np.ndarray:
    """One hash per run of `rows` registers."""
    out = np.zeros((len(won), won.shape[1] // rows), np.uint64)
    for k in range(rows):
        with np.errstate(over="ignore"):
            out = mix(out + won[:, k::rows] + MIX[0])
    return out
