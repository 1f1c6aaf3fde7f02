"""Exact and near copies, repeated passages and nearest neighbours against brute force."""

import collections
import itertools
import random

import numpy as np
import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import columnwise, exact, hamming, links, near, suffixes
from tidemark.llm.probminhash import WordHashes, shingles, signatures, similarity
from tidemark.llm.trie import PatriciaTrie


def frame(spark, rows):
    """Rows with extra columns whose names the operators use themselves."""
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("e") for c in ("_id", "row", "kept", "key", "label", "body", "starts")})


# Exact copies


@pytest.mark.parametrize("budget", [1 << 30, 2000, 1])
def test_trie_equals_a_dictionary_with_and_without_spill(budget):
    rng, trie, want = random.Random(1), PatriciaTrie(budget), {}
    for k in range(2000):
        key = bytes(rng.choice(b"ab") for _ in range(rng.randrange(9)))
        trie.insert(key, (k * 7919) % 2003, 1, k)
        want.setdefault(key, []).append(k)
    assert (trie.spills > 0) == (budget < 1 << 30)
    got = {key: (node.owner, node.count, sorted(node.members)) for key, node in trie.terminals()}
    assert got == {key: (min(k * 7919 % 2003 for k in ks), len(ks), ks) for key, ks in want.items()}


def test_exact_owners(spark):
    rows = [(5, "a b"), (3, "a \t\nb"), (4, "a b "), (4, "a b"), (4, "a b"), (2, None), (1, ""), (None, "q"), (None, "q"), (6, "long " * 50_000), (7, "long " * 50_000)]
    for budget in (1 << 20, 10):
        found = exact.exact_owners(frame(spark, rows), budget=budget).collect()
        assert len(found) == len(rows) and sum(r.kept for r in found) == 5
        by_text = collections.defaultdict(set)
        for r in found:
            by_text[r.text_sha256].add((r.keep_id, r.group_size))
        assert sorted(by_text.values(), key=str) == sorted([{(3, 4)}, {(4, 1)}, {(1, 2)}, {(None, 2)}, {(6, 2)}], key=str)
    stay = exact.drop_copies(frame(spark, rows))
    assert sorted((r.doc_id or 0, (r.text or "")[:6]) for r in stay.collect()) == [(0, "q"), (1, ""), (3, "a \t\nb"), (4, "a b "), (6, "long l")]
    assert exact.exact_owners(frame(spark, rows).filter("false")).count() == 0


# Near copies


def test_probability_jaccard():
    one = np.ones(3, np.int64)
    a, b = (np.array([1, 2, 3], np.uint64), one), (np.array([2, 3, 4], np.uint64), one)
    assert similarity(a, b) == 0.5
    rng = np.random.default_rng(2)
    for _ in range(50):
        x, y = rng.integers(0, 4, 12), rng.integers(0, 4, 12)
        want = sum(1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in range(12)) for i in range(12) if x[i] and y[i])
        sets = [(np.flatnonzero(z).astype(np.uint64), z[z > 0]) for z in (x, y)]
        if all(len(s[0]) for s in sets):
            assert similarity(*sets) == pytest.approx(want)


def test_registers_agree_as_often_as_the_similarity_says():
    rng, sets = np.random.default_rng(3), []
    for _ in range(2):
        weights = rng.integers(0, 5, 300)
        sets.append((np.flatnonzero(weights).astype(np.uint64) * np.uint64(7919), weights[weights > 0]))
    won = signatures(sets, 6000)
    assert (won[0] == won[1]).mean() == pytest.approx(similarity(*sets), abs=0.03)


def brute_classes(rows):
    hashes = WordHashes()
    sets = [shingles(t or "", 5, hashes) for _, t in rows]
    top = list(range(len(rows)))

    def find(k):
        while top[k] != k:
            k = top[k]
        return k

    for i, j in itertools.combinations(range(len(rows)), 2):
        if similarity(sets[i], sets[j]) >= 0.8:
            a, b = find(i), find(j)
            top[max(a, b)] = min(a, b)
    return [find(k) for k in range(len(rows))]


def test_near_classes_equal_all_pairs(spark):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for _ in range(12):
        base = rng.choices(words, k=120)
        for _ in range(12):
            copy = list(base)
            for _ in range(rng.randrange(8)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows), " ".join(copy)))
    rows += [(900, "only three words"), (901, "only  three words"), (902, None), (903, " "), (904, "x " * 30_000), (904, "x " * 30_000)]
    found = near.near_classes(frame(spark, rows)).collect()
    want = brute_classes(rows)
    smallest: dict[int, int] = {}
    for (i, _), c in zip(rows, want):
        smallest[c] = min(smallest.get(c, i), i)
    by_id = {i: smallest[c] for (i, _), c in zip(rows, want)}
    assert {r.doc_id: r.class_id for r in found} == by_id
    assert len(found) == len(rows) and sum(r.kept for r in found) == len(set(want))
    assert near.drop_near_copies(frame(spark, rows)).count() == len(set(want))
    assert near.near_classes(frame(spark, rows).filter("false")).count() == 0


def test_components_equal_union_find(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 340)]
    found = {r.node: r.label for r in links.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    group = {x: x for p in pairs for x in p}
    for _ in range(60):
        for a, b in pairs:
            group[a] = group[b] = min(group[a], group[b])
    assert found == {k: v for k, v in group.items() if any(k in p and p[0] != p[1] for p in pairs)}


# Repeated passages


@pytest.mark.parametrize("block", [1 << 20, 7, 3])
def test_transform_and_common_prefixes(block):
    rng = random.Random(6)
    for _ in range(60):
        strings = [[rng.randrange(3) for _ in range(rng.randrange(12))] for _ in range(rng.randrange(1, 8))]
        bwt, lcp = columnwise.build([np.array(s, np.int64) for s in strings], 3, block)
        rows = sorted((s[k:], s[k - 1] if k else 3) for s in strings for k in range(len(s) + 1))
        shared = [0] + [next((n for n, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) for (a, _), (b, _) in zip(rows, rows[1:])]
        assert lcp.tolist() == shared
        at = 0
        for _, same in itertools.groupby(rows, key=lambda r: r[0]):
            same = [s for _, s in same]
            assert sorted(bwt[at : at + len(same)].tolist()) == sorted(same)
            at += len(same)


def brute_removed(texts, width):
    count = collections.Counter(t[k : k + width] for t in texts for k in range(len(t) - width + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - width + 1):
            if count[t[k : k + width]] > 1:
                gone[k : k + width] = True
        out.append(gone)
    return out


def test_removed_bytes_equal_brute_force(spark):
    rng = random.Random(7)
    passage = "".join(rng.choice("abcdé ") for _ in range(300))
    texts = [passage[rng.randrange(100) : 150 + rng.randrange(150)].join("".join(rng.choice("uvwxyz") for _ in range(60)) for _ in range(2)) for _ in range(40)]
    texts += ["of " * 100, "ab" * 37, "", None, "same row", texts[0], texts[0], "".join(rng.choice("pqr") for _ in range(40)) * 2]
    found = suffixes.remove_repeats(frame(spark, list(enumerate(texts))), width=40, anchor=20, budget=3000).collect()
    bodies = [(t or "").encode() for t in texts]
    for r, body, gone in zip(sorted(found, key=lambda r: r.doc_id), bodies, brute_removed(bodies, 40)):
        runs = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]]))).reshape(-1, 2)
        assert (r.n_bytes, r.n_removed) == (len(body), int(gone.sum()))
        assert list(zip(r.starts, r.ends)) == [tuple(x) for x in runs.tolist()]
        assert bytes(r.kept) == np.frombuffer(body, np.uint8)[~gone].tobytes()
    assert suffixes.remove_repeats(frame(spark, [(1, "a")]).filter("false")).count() == 0


def test_planted_passages_go_from_400_bytes_on(spark):
    rng = random.Random(31)
    words = lambda n, low, high: " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(low, high))) for _ in range(n))
    passages = [words(55, 2, 6) for _ in range(10)] + [words(55, 7, 9) for _ in range(5)] + [words(80, 4, 8)[:n] for n in (398, 399, 400, 401)]
    assert {len(p) >= 400 for p in passages} == {True, False} and all(len(p.split()) > 50 for p in passages)
    # Each in two texts; the letters beside it differ, so that nothing repeats with it.
    texts, spans = [words(300, 2, 8) for _ in range(10)], [[]] * 10
    for p, (a, b) in itertools.product(passages, ("xX", "yY")):
        texts.append(f"{(head := words(80, 2, 8))}{a}{p}{b}{words(80, 2, 8)}")
        spans.append([(len(head) + 1, len(head) + 1 + len(p))] if len(p) >= 400 else [])
    found = suffixes.remove_repeats(frame(spark, list(enumerate(texts)))).collect()
    assert [list(zip(r.starts, r.ends)) for r in sorted(found, key=lambda r: r.doc_id)] == spans


@pytest.mark.parametrize("budget", [0, 3000])
def test_hot_anchors_are_counted_and_never_sorted_together(spark, monkeypatch, budget):
    rng = random.Random(17)
    passage = "".join(rng.choice("abcdé ") for _ in range(70))
    texts = ["".join(rng.choice("uvwxyz") for _ in range(60)) + passage[rng.randrange(12) : 50 + rng.randrange(20)] + "".join(rng.choice("uvwxyz") for _ in range(60)) for _ in range(120)]
    texts += ["of " * 100, "ab" * 37, "", None, "same row", texts[0], "x" * 500 + passage, passage * 3, *(f"{k:03d}" + "ab" * 40 + f"{k:03d}" for k in range(60))]
    real = suffixes._sort_suffixes

    def bounded(width, budget):
        def run(batches):
            sizes = {}

            def counted():
                for batch in batches:
                    for anchor, body in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                        sizes[anchor] = sizes.get(anchor, 0) + len(body)
                        assert sizes[anchor] <= budget, "one anchor beyond the budget"
                    yield batch

            yield from real(width, budget)(counted())

        return run

    monkeypatch.setattr(suffixes, "_sort_suffixes", bounded)
    found = suffixes.remove_repeats(frame(spark, list(enumerate(texts))), width=40, anchor=20, budget=budget).collect()
    bodies = [(t or "").encode() for t in texts]
    gone = [[tuple(x) for x in np.flatnonzero(np.diff(np.concatenate([[0], g, [0]]))).reshape(-1, 2).tolist()] for g in brute_removed(bodies, 40)]
    assert [list(zip(r.starts, r.ends)) for r in sorted(found, key=lambda r: r.doc_id)] == gone


def test_long_texts_are_cut_in_chunks(monkeypatch):
    data = np.frombuffer(random.Random(8).randbytes(5000), np.uint8)
    whole = suffixes.Cutter(400, 200).cut(data)
    monkeypatch.setattr(suffixes, "CHUNK", 700)
    parts = suffixes.Cutter(400, 200).cut(data)
    expand = lambda c: {(int(s) + k): int(a) for s, n, a, _ in zip(*c) for k in range(n)}
    assert expand(whole) == expand(parts) and len(expand(whole)) == 4601


# Nearest neighbours


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(9)
    vectors = rng.normal(size=(600, 16)) * rng.uniform(0.5, 2, (600, 1))
    vectors[100:140] = vectors[100]
    rows = [(k, v.tolist()) for k, v in enumerate(vectors)]
    rows += [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [None] + [1.0] * 15), (1004, [1.0, 2.0]), (None, [1.0] * 16), (7, vectors[7].tolist())]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit("e")).withColumn("v", F.lit(0))
    found = collections.defaultdict(list)
    for r in hamming.nearest(table, F.pmod(F.col("id"), F.lit(20)) == 0).collect():
        found[r.query_id].append((r.rank, r.vec_id, r.score))
    assert set(found) == set(range(0, 600, 20))
    hits = 0
    for q, rows_ in found.items():
        rows_.sort()
        assert [r[0] for r in rows_] == list(range(1, 21)) and q not in [r[1] for r in rows_]
        scores = vectors @ vectors[q]
        assert np.allclose([r[2] for r in rows_], [scores[r[1]] for r in rows_], rtol=1e-12)
        best = [k for k in np.lexsort((np.arange(600), -scores)) if k != q][:20]
        hits += len({r[1] for r in rows_} & set(best))
    assert hits / (20 * len(found)) >= 0.9
    assert hamming.nearest(table.filter("false"), F.lit(True)).count() == 0


def test_probing_finds_every_code_within_the_radius():
    codes = np.random.default_rng(10).integers(0, 256, (500, hamming.PARTS), np.uint8)
    index = hamming.MultiIndex(codes)
    far = np.bitwise_count(codes ^ codes[3]).sum(1, dtype=int)
    for pool in (1, 10, 499, 500, 900):
        got = index.within(codes[3], pool)
        radius = np.sort(far)[min(pool, 500) - 1]
        assert sorted(got.tolist()) == np.flatnonzero(far <= radius).tolist()


# The pipeline


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(11)
    words = [f"{a}{b}" for a in "bcdfgh" for b in ("ana", "ero", "ilu", "oto", "emi")]
    prose = lambda: " ".join(rng.choices(words, k=60))
    texts = [prose() + (" vile vile vile" if k % 5 == 0 else "") for k in range(300)]
    texts += [texts[1], texts[1] + " ", texts[2] + " extra", "card 4111111111111111", None]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs.select("doc_id", F.lit(1).alias("quality"), (F.col("text").contains("vile")).cast("int").alias("toxic")).write.parquet(f"{tmp_path}/labels.parquet")
    seen, at = {}, spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        at = corpus_pipeline.keep(stage(spark, at, str(tmp_path)), name)
        seen[name] = at
    assert all(seen[n].columns == docs.columns for n in list(seen)[:-1])
    ids = {n: {r.doc_id for r in f.select("doc_id").collect()} for n, f in seen.items()}
    clean = {k for k, t in enumerate(texts) if "vile" not in (t or "")}
    assert ids["toxicity"] == clean
    assert ids["exact_dedup"] == clean - {300}
    assert ids["near_dedup"] == clean - {300, 301, 302} == ids["pii"] == ids["packing"]
    assert seen["pii"].filter("doc_id = 303").first().text != "card 4111111111111111"
    empty = spark.read.parquet(f"{tmp_path}/documents.parquet").filter("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
