"""Toxicity, encoding, pseudonyms, packing, sharding and chat formatting on small fixtures."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from pyspark.sql import functions as F

from tidemark.llm import chat, packing, pieces, pseudonyms, sharding, toxicity

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = [(1, "one two"), (1, "one two"), (2, None), (3, ""), (None, "x"), (4, "word " * 40_000), (5, "z" * 90_000)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, ties, repeated rows, very long texts, and extra columns with names the operators use themselves."""
    extra = [F.lit("e").alias(c) for c in ("_body", "body", "score", "kept", "row", "bin", "key", "ids")]
    return spark.createDataFrame(ODD, "doc_id long, text string").select("*", *extra)


@pytest.fixture(scope="module")
def none(odd):
    return odd.filter("false")


# Toxicity


def test_machine_learns_a_pair_that_single_terms_miss():
    rng = random.Random(1)
    lists, labels = [], []
    for _ in range(3000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        lists.append([0] * a + [1] * b + [rng.randrange(2, 20)])
        labels.append(int(a != b))
    found = toxicity.fit(lists, labels, 20, toxicity.Settings())
    said = found.scores(lists) >= 0.5
    assert (said == np.array(labels, bool)).mean() > 0.95


def test_toxicity_odd_rows_and_labels(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 1), (3, 0)], "doc_id long, toxic int")
    for docs, count in ((odd, len(ODD)), (none, 0)):
        rows = toxicity.score_toxicity(docs, labels).collect()
        assert len(rows) == count and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert {r.score for r in toxicity.score_toxicity(odd, labels.filter("false")).collect()} == {0.5}


def test_toxicity_held_out(spark):
    import zlib

    rng = random.Random(2)
    words = [f"{a}{b}" for a in "bcdfghklm" for b in ("ana", "ero", "ilu", "oto")]
    docs = [(k, " ".join(rng.choices(words, k=30) + (["vile"] * 3 if k % 4 == 0 else []))) for k in range(600)]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic"))
    rows = toxicity.score_toxicity(docs, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(r.predicted == (r.doc_id % 4 == 0) for r in rows if r.held_out)


def test_repeated_ids_stay_within_the_sample(spark, monkeypatch):
    word = lambda k: chr(97 + k % 26) * (2 + k // 26)
    docs = [(k, word(k)) for k in range(30)]
    learned, real = [], toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda lists, y, terms, s: learned.append(len(y)) or real(lists, y, terms, s))
    labels = spark.createDataFrame([(k, k % 2) for k in range(30)], "doc_id long, toxic int")
    for more in ([], [(3, word(3))] * 200, [(k, f"{word(k)} {word(j + 30)}") for k in range(30) for j in range(20)]):
        toxicity.learn(spark.createDataFrame(docs + more, "doc_id long, text string"), labels, s=toxicity.Settings(sample=40, steps=1))
    assert 0 < learned[0] == learned[1] <= 30 and learned[2] == 40


# Encoding


def test_pieces_equal_the_library_with_spans():
    mine, library = pieces.PieceModel(open(MODEL, "rb").read()), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(3)
    parts = ["a", " ", "  ", "\n", "▁", "é", "日", "😀", "\0", "<0x41>", "</s>", "the", "ing", "​", "ﬁ", "x" * 200]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(400)]
    ids, first, end, stop = mine.encode_all(texts)
    for k, text in enumerate(texts):
        want = library.encode(text, return_type="proto").pieces
        span = slice(stop[k], stop[k + 1])
        assert list(zip(ids[span].tolist(), first[span].tolist(), end[span].tolist())) == [(p.id, p.begin, p.end) for p in want]
    assert mine.decode_all(ids, stop).to_pylist() == library.decode([ids[stop[k] : stop[k + 1]].tolist() for k in range(len(texts))])
    for _ in range(300):
        some = [rng.choice([0, 1, 2, rng.randrange(3, 259), rng.randrange(259, 32000)]) for _ in range(rng.randrange(8))]
        assert mine.decode(some) == library.decode(some)


def test_a_slice_with_more_units_than_the_cache_holds(monkeypatch):
    data = open(MODEL, "rb").read()
    first, long = "the cat and the dog", "the " + " ".join(f"word{k}" for k in range(40))
    want = [pieces.PieceModel(data).encode(t) for t in (first, long, first)]
    monkeypatch.setattr(pieces, "CACHED_UNITS", 10)
    model = pieces.PieceModel(data)
    for text, (ids, start, end) in zip((first, long, first), want):
        found = model.encode(text)
        assert (found[0], found[1].tolist(), found[2].tolist()) == (ids, start.tolist(), end.tolist())


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
@pytest.mark.parametrize("squeeze", [False, True])
def test_character_map_equals_the_library(rule, squeeze):
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    model.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
    spec = model.normalizer_spec
    spec.add_dummy_prefix, spec.escape_whitespaces, spec.remove_extra_whitespaces = True, True, squeeze
    library = sentencepiece.SentencePieceNormalizer(model_proto=model.SerializeToString(), add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=squeeze)
    mine, rng = pieces.CharMap(spec.precompiled_charsmap), random.Random(4)
    for _ in range(500):
        text = "".join(rng.choice(["a", " ", "\t", "é", "日", "ﬁ", "​", "　", "½", "Ａ"]) for _ in range(rng.randrange(12)))
        want, at = library.normalize(text, with_offsets=True)
        got, source = mine.normalise(text, True, squeeze)
        assert got == want
        assert [len(text.encode()[:b].decode()) for b in source.tolist()] == at


def test_encode_and_decode_odd_rows(odd, none):
    rows = pieces.decode_ids(pieces.encode_texts(odd, MODEL), MODEL).collect()
    assert sorted((r.decoded for r in rows)) == sorted((t or "") for _, t in ODD)
    assert all(len(r.ids) == len(r.starts) == len(r.ends) for r in rows)
    assert pieces.decode_ids(pieces.encode_texts(none, MODEL), MODEL).count() == 0


# Pseudonyms


def test_feistel_is_a_permutation():
    for size in (1, 2, 7, 100, 1000):
        net = pseudonyms.Feistel(b"k", "t", size)
        seen = [net.permute(x) for x in range(size)]
        assert sorted(seen) == list(range(size)) and [net.permute(y, back=True) for y in seen] == list(range(size))


VALUES = [
    ("card", "4111111111111111"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (974) 555-3436"), ("ip", "97.51.17.173"), ("ssn", "123-45-6789"),
    ("iban", "DE89 3704 0044 0532 0130 00"), ("date", "2024-02-29"), ("date", "29.02.2024"), ("date", "12/31/1999"), ("date", "3/4/1999"),
    ("email", "jo.el7@mail4.example.com"), ("secret", "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"),
]


@pytest.mark.parametrize("kind, value", VALUES)
def test_pseudonyms_keep_the_format_and_invert(kind, value):
    there, back = pseudonyms.Pseudonymiser(b"k"), pseudonyms.Pseudonymiser(b"k", back=True)
    new = there.value(kind, value)
    assert new != value and re.sub(r"[0-9]", "9", re.sub(r"[a-z]", "a", new)).translate(str.maketrans("a", "9")) == re.sub(r"[0-9a-z]", "9", value)
    assert back.value(kind, new) == value
    quoted = f'token = "{value}"' if kind == "secret" else value
    text, found = there.text(f"see {quoted}.")
    assert [f[0] for f in found] == [kind] and new in text and len(text) == len(f"see {quoted}.")


def test_invalid_values_stay_and_copies_link():
    work = pseudonyms.Pseudonymiser(b"k")
    for text in ("4111111111111112", "999.1.1.1", "2023-02-30", "000-12-3456", "DE89 3704 0044 0532 0130 01"):
        assert work.text(text) == (text, [])
    a, b = work.text("4111111111111111")[0], work.text("x 4111 1111 1111 1111 y")[0]
    assert a == re.sub(" ", "", b[2:-2])


def test_pseudonymise_odd_rows(odd, none):
    done = pseudonyms.pseudonymise(odd, "k")
    assert done.columns == [*odd.columns, "pii"]
    assert sorted((r.doc_id or -1, r.text or "") for r in done.collect()) == sorted((i or -1, t or "") for i, t in ODD)
    assert pseudonyms.pseudonymise(none, "k").count() == 0


# Packing


def test_packing_covers_every_text_once(odd, none):
    rows = packing.pack_texts(odd, sizes=(1000, 4000, 30000), group_items=5).collect()
    assert sum(r.length for r in rows) == sum(len((t or "").encode()) + 1 for _, t in ODD)
    bins: dict[int, list] = {}
    for r in rows:
        bins.setdefault(r.bin, []).append(r)
    for packed in bins.values():
        packed.sort(key=lambda r: r.bin_offset)
        at = 0
        for r in packed:
            assert r.bin_offset == at
            at += r.length
        assert at <= packed[0].bin_size == min(s for s in (1000, 4000, 30000) if s >= at)
    assert packing.pack_texts(none).count() == 0


def test_best_fit_takes_the_tightest_bin_and_shrinks_it():
    of, at, sizes, _ = packing.best_fit([60, 30, 40, 8], (50, 100), (50.0, 100.0), 100)
    assert of == [0, 0, 1, 0] and at == [0, 60, 0, 90] and sizes == [100, 50]


def test_packing_near_the_cheapest_plan():
    rng = np.random.default_rng(5)
    lengths = rng.integers(1, 900, 2000)
    bins, _, sizes = packing.pack_group(lengths, (256, 512, 1024), packing.costs((256, 512, 1024)))
    used = np.bincount(bins, lengths)
    final = np.zeros(len(used))
    final[bins] = sizes
    assert (used <= final).all() and used.sum() / final.sum() > 0.97


# Sharding


def jump(key: int, shards: int) -> int:
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * sharding.MULTIPLIER + 1) % (1 << 64)
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_shards_equal_plain_arithmetic_and_only_move_to_the_new_one(spark):
    ids = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    for r in sharding.assign_shards(ids, 7).collect():
        key = int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:16], 16)
        assert (r.shard, r.grown_shard) == (jump(key, 7), jump(key, 8))
        assert r.grown_shard in (r.shard, 7)


def test_slots_have_no_gaps(odd, none):
    rows = sharding.assign_shards(odd, 3).collect()
    assert len(rows) == len(ODD)
    for s in range(3):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert {r.size for r in rows if r.doc_id in (2, 3)} == {16} and {r.text_crc32 for r in rows if r.doc_id in (2, 3)} == {0}
    assert sharding.assign_shards(none, 3).count() == 0


# Chat


def test_escapes_come_back_and_leave_no_control_string(spark):
    rng, parts = random.Random(6), ["\\", "<|", "|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", chat.HEAD, chat.END, "a", "\n", "é", "$1"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(300)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e")).select("t", "e", chat.unescape(F.col("e")).alias("u"))
    for r in rows.collect():
        assert r.u == r.t and not re.search(r"<\||</?s>|\[/?INST\]|<</?SYS>>", r.e)


def test_one_example_per_reply(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "a</s>"), (1, 2, "user", "more"), (1, 3, "assistant", "b"), (2, 0, "user", None), (None, 1, None, "x"), (3, None, "assistant", ""), (3, None, "assistant", "")]
    docs = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit("clash"))
    examples = chat.format_examples(docs)
    rows = {(r.conv_id, r.example): r for r in examples.collect()}
    assert {k: r.n_turns for k, r in rows.items()} == {(1, 0): 2, (1, 1): 4, (2, 0): 1, (None, 0): 1, (3, 0): 1, (3, 1): 2}
    assert rows[1, 1].formatted.startswith(rows[1, 0].formatted)
    assert rows[1, 0].formatted[rows[1, 0].loss_start : rows[1, 0].loss_end] == "a<\\/s>"
    said = {r.conv_id: r for r in chat.conversation_digests(examples).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert said[1].loss_sha256 == sha("a</s>b") and said[1].loss_chars == 6
    assert said[1].turns_sha256 == sha("user\nhi\nassistant\na</s>\nuser\nmore\nassistant\nb\n") and said[1].n_turns == 4
    assert (said[2].n_turns, said[2].loss_chars, said[3].n_turns) == (1, 0, 2)
    assert chat.conversation_digests(chat.format_examples(docs.filter("false"))).count() == 0
