"""Language identification: n-grams against plain counting, held-out accuracy, rejection, odd rows."""

import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import language

SYLLABLES = {"aa": "ba ko ri tu mel san", "bb": "sch tz ung ich er ein", "cc": "ção nho á lh os em", "dd": "ка ни ло ве пра сто"}


def words(rng, lang, n):
    parts = SYLLABLES[lang].split()
    return " ".join("".join(rng.choices(parts, k=rng.randrange(1, 4))) for _ in range(n))


def plain_ngrams(text, orders):
    codes = [c if c.isalpha() else " " for c in text.lower()]
    squeezed = " " + "".join(c for k, c in enumerate(codes) if c != " " or (k and codes[k - 1] != " "))
    squeezed += " " if codes and codes[-1] != " " else ""
    return Counter(g for n in range(1, orders + 1) for k in range(len(squeezed) - n + 1) if (g := squeezed[k : k + n]).strip())


def test_ngrams_equal_plain_counting():
    s, rng = language.Settings(), random.Random(1)
    texts = ["".join(rng.choice("aB é,日1 \n😀") for _ in range(rng.randrange(30))) for _ in range(200)] + ["", "1", "x" * 3000]
    row, bucket = language.ngrams(texts, s)
    names: dict[int, str] = {}
    for k, text in enumerate(texts):
        want = plain_ngrams(text, s.orders)
        assert sorted(Counter(bucket[row == k].tolist()).values()) == sorted(want.values())
        for gram, n in want.items():  # the same n-gram has the same bucket in every text
            alone = language.ngrams([gram.strip()], s)[1]
            assert set(alone.tolist()) & set(bucket[row == k].tolist())
            names.update({int(b): gram for b in alone[:1]})


def test_centroids_are_the_clusters():
    rng = np.random.default_rng(2)
    hubs = np.eye(6, dtype=np.float32)[:3]
    x = language.unit(np.abs(hubs[np.arange(90) % 3] + 0.05 * rng.random((90, 6))).astype(np.float32))
    centroids, of = language.cluster(x, 3, 10)
    assert len({tuple(of[np.arange(90) % 3 == k]) for k in range(3)}) == 3 and (centroids[of] * x).sum(1).min() > 0.98
    assert len(language.cluster(x[:1], 5, 3)[0]) == 1  # copies of one row make one cluster


def test_held_out_documents_and_rejection(spark):
    rng = random.Random(3)
    rows = [(k, words(rng, lang, rng.randrange(5, 60)), lang) for k, lang in enumerate(rng.choices(list(SYLLABLES), [60, 20, 15, 5], k=900))]
    wrong = [(k, t, "aa" if k % 31 == 0 else lang) for k, t, lang in rows]
    far = [(-k, "ℵΩψ ωφχ " * 5, None) for k in range(1, 4)]
    found = {r.doc_id: r for r in language.identify_languages(spark.createDataFrame(wrong + far, "doc_id long, text string, lang string")).collect()}
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 3 == 1) for k, r in found.items())
    tested = [(found[k].lang_pred, lang) for k, _, lang in rows if found[k].held_out]
    assert np.mean([a == b for a, b in tested]) > 0.98
    assert all(0 <= r.score <= 1 for r in found.values())
    assert all(found[k].rejected and found[k].lang_pred == "aa" for k, _, _ in far)
    assert np.mean([found[k].rejected for k, _, _ in rows]) < 0.02


def test_odd_rows(spark):
    odd = [(1, "ba ko", "aa"), (1, "ba ko", "aa"), (2, None, "aa"), (3, "", None), (None, "ba ri", "aa"), (4, "12 34 !", "bb"), (5, "schung ich " * 150_000, "bb"), (6, "schung", None), (7, "x", None)]
    docs = spark.createDataFrame(odd, "doc_id long, text string, lang string").select("*", *[F.lit("e").alias(c) for c in ("score", "letter", "h", "held_out", "lang_pred")])
    rows = language.identify_languages(docs).collect()
    assert len(rows) == len(odd)
    for r in rows:
        assert (r.lang_pred == "und") == (r.doc_id in (2, 3, 4)) and (r.lang_pred != "und" or r.score == 0)
    nothing = language.identify_languages(docs.filter("lang is null")).collect()
    assert len(nothing) == 3 and {(r.lang_pred, r.score, r.rejected) for r in nothing} == {("und", 0.0, True)}
    assert language.identify_languages(docs.filter("false")).count() == 0
