"""Fill-in-the-middle examples against plain string slicing."""

import hashlib
import random

from pyspark.sql import functions as F

from tidemark.llm import middle


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def plainly(doc_id: int | None, text: str | None) -> tuple[str, str, int, int | None, int | None]:
    text, digest = text or "", sha(f"1:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return text, "plain", n, None, None
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return f"<S>{s}<P>{p}<M>{m}", "spm", n, len(p), len(m)
    return f"<P>{p}<S>{s}<M>{m}", "psm", n, len(p), len(m)


def test_examples_equal_slices_and_come_back(spark):
    rng, parts = random.Random(1), ["a", "é", "日", "😀", "\n", "<", "P>", "<S", "\0", "é", " "]
    rows = [(k, "".join(rng.choice(parts) for _ in range(rng.randrange(40)))) for k in range(400)]
    rows += [(1, "one two"), (1, "one two"), (None, "x y"), (None, None), (401, ""), (402, "😀word " * 60_000), (403, "x<M>y")]
    clash = [F.lit("e").alias(c) for c in ("n", "form", "pieces", "a", "h1", "digest", "output")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", *clash)
    tables = middle.piece_tables(docs)
    back = middle.restore_texts(middle.write_examples(tables)).collect()
    want = sorted(((i if i is not None else -1, t or "", *plainly(i, t)) for i, t in rows), key=str)
    assert sorted(((r.doc_id if r.doc_id is not None else -1, r.restored, r.output, r.form, r.n, r.prefix_chars, r.middle_chars) for r in back), key=str) == want
    assert all(r.text == r.restored for r in back) and {r.form for r in back} == {"plain", "psm", "spm"}
    said = middle.digest_examples(tables).collect()
    assert sorted((r.output_sha256, r.restored_sha256) for r in said) == sorted((sha(w[2]), sha(w[1])) for w in want)
    assert middle.digest_examples(middle.piece_tables(docs.filter("false"))).count() == 0


def test_cuts_split_descriptors_without_copies():
    whole = middle.PieceTable([b"abcdef", b"XY"], [(0, 0, 4), (1, 0, 2), (0, 4, 2)])
    left, mid, right = whole.cut([2, 5])
    assert (left.pieces, mid.pieces, right.pieces) == ([(0, 0, 2)], [(0, 2, 2), (1, 0, 1)], [(1, 1, 1), (0, 4, 2)])
    turned = whole.arrange([left, mid, right], (2, 0, 1))
    assert turned.content() == b"YefabcdX" and turned.sha256() == hashlib.sha256(b"YefabcdX").hexdigest()
    assert all(v.obj in (b"abcdef", b"XY") for v in turned.views)


def test_other_rules(spark):
    rule = middle.Rule(sentinels=("<|pre|>", "<|suf|>", "<|mid|>"), plain=0, spm=100, seed="x")
    docs = spark.createDataFrame([(k, f"text number {k}") for k in range(20)], "doc_id long, text string")
    rows = middle.restore_texts(middle.write_examples(middle.piece_tables(docs, rule=rule), rule), rule).collect()
    assert all(r.form == "spm" and r.output.startswith("<|suf|>") and r.restored == r.text for r in rows)
