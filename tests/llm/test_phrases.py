"""Phrase mining against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import phrases


def plain_counts(rows):
    counts = {}
    for lang, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            c = counts.setdefault("und" if lang is None else lang, Counter())
            for n in range(1, 5):
                c.update(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
    return counts


def plain_phrases(rows, s):
    out = []
    for lang, f in plain_counts(rows).items():
        n, found = sum(v for k, v in f.items() if len(k) == 1), []
        common = {p: a for p, a in f.items() if len(p) > 1 and a >= s.least}
        for p, a in common.items():
            score, _, left, right = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            longer = [b for q, b in common.items() if len(q) > len(p) and any(q[k : k + len(p)] == p for k in range(len(q)))]
            if not any(100 * b >= s.covered * a for b in longer):
                found.append((lang, " ".join(p), a, left, right, n, score))
        found.sort(key=lambda x: (-x[6], -x[2], x[1].encode()))
        out += [(x[0], k + 1, *x[1:]) for k, x in enumerate(found[: s.top])]
    return sorted(out)


def corpus(seed, n=300):
    rng = random.Random(seed)
    words = ["the", "The", "of", "a", "é", "日本", "x1", "\0", "b-c", "zu", "in"]
    notice = "all rights are reserved by the owner of a thing"
    rows = []
    for _ in range(n):
        parts = [rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", " \x0b"]) for _ in range(rng.randrange(40))]
        rows.append((rng.choice(["aa", "aa", "aa", "bb", None]), "".join(parts) + (notice if rng.random() < 0.4 else "")))
    return rows + [("aa", None), ("aa", ""), (None, " .,"), ("bb", notice.upper()), ("bb", notice.upper()), ("cc", "word " * 3000), ("dd", "one, two")]


@pytest.mark.parametrize("every, top, block", [(24, 2000, 6 << 20), (2, 5, 3000), (10**9, 2000, 500)])
def test_phrases_equal_plain_counting(spark, monkeypatch, every, top, block):
    monkeypatch.setattr(phrases, "BLOCK", block)
    rows, s = corpus(every), phrases.Settings(least=30, top=top, every=every)
    clash = [F.lit("e").alias(c) for c in ("phrase", "chunk", "own", "freq", "n")]
    docs = spark.createDataFrame(rows, "lang string, text string").select("*", *clash).repartition(5)
    found = phrases.mine_phrases(docs, s=s)
    assert sorted(tuple(r) for r in found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()) == plain_phrases(rows, s)
    assert phrases.mine_phrases(docs.filter("false"), s=s).count() == 0


def test_all_counts_and_copies_in_one_chunk(spark):
    rows = corpus(5, 60) + corpus(5, 60)
    docs = spark.createDataFrame(rows, "lang string, text string")
    f = phrases.frequent_phrases(docs, s=phrases.Settings(least=3)).collect()
    want = {(lang, " ".join(p)): n for lang, c in plain_counts(rows).items() for p, n in c.items() if n >= 3}
    assert {(r.lang, r.phrase): r.f for r in f if r.words} == want
    chunks = phrases.chunk_dictionary(docs).collect()
    assert all(r.freq % 2 == 0 for r in chunks)  # copies parse alike and are stored once
    assert len({(r.lang, r.chunk, r.own) for r in chunks}) == len(chunks)


def test_every_start_has_one_owner_and_passages_parse_alike():
    rng = random.Random(6)
    words = [f"w{k}" for k in range(50)]
    passage = " ".join(rng.choices(words, k=400))
    texts = [" ".join(rng.choices(words, k=rng.randrange(700))) for _ in range(20)] + ["", passage, f"a b c {passage} d"]
    tokens, text = phrases.tokens_of([t.encode() for t in texts])
    first, own, stop = phrases.parse(tokens, text, 24)
    assert phrases.ranges(first, own).tolist() == list(range(len(tokens)))
    assert all(text[a] == text[z - 1] and z - a <= phrases.CHUNK + 3 for a, z in zip(first, stop))
    ends = np.searchsorted(text, text[first], "right")
    assert all(z == min(a + o + 3, e) for a, o, z, e in zip(first, own, stop, ends))
    cut = [{tuple(tokens[a:z].to_pylist()) for a, z, of in zip(first, stop, text[first]) if of == k} for k in (21, 22)]
    assert len(cut[0] & cut[1]) >= len(cut[0]) - 3
