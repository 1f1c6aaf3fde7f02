"""Registered queries of the operators and the SQL that checks them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.chat import conversation_digests, format_examples
from tidemark.llm.exact import exact_owners
from tidemark.llm.frames import packed, table
from tidemark.llm.hamming import nearest
from tidemark.llm.language import identify_languages
from tidemark.llm.middle import digest_examples, piece_tables
from tidemark.llm.near import near_classes
from tidemark.llm.packing import pack_texts
from tidemark.llm.phrases import mine_phrases
from tidemark.llm.pieces import decode_ids, encode_texts
from tidemark.llm.pseudonyms import pseudonymise
from tidemark.llm.sharding import MULTIPLIER, assign_shards
from tidemark.llm.suffixes import remove_repeats
from tidemark.llm.toxicity import score_toxicity

SHARDS = 40


def pii_key() -> str:
    """Secret of the permutations; production sets TIDEMARK_PII_KEY."""
    return os.environ.get("TIDEMARK_PII_KEY", "a key for tests")


def op1_variable_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_texts(table(spark, sf_dir, "documents"))


def op2_fm_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def piece_model() -> str:
    """Path of the public BPE model; another file by TIDEMARK_PIECE_MODEL."""
    import public_tokenizers

    return os.environ.get("TIDEMARK_PIECE_MODEL") or public_tokenizers.path("piece_bpe_32k.model")


def op3_piece_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = piece_model()
    coded = decode_ids(encode_texts(table(spark, sf_dir, "documents"), model), model)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        F.coalesce(F.try_element_at("ends", F.lit(-1)), F.lit(0)).cast("long").alias("spanned_bytes"),
    )


def op4_column_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beside the digests what the removal leaves: the text (cut characters replaced), its share, and whether any went."""
    done = remove_repeats(table(spark, sf_dir, "documents"))
    return done.select(
        "doc_id", "n_bytes", "n_removed", F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
        F.make_valid_utf8(F.col("kept").cast("string")).alias("kept_text"),
        F.when(F.col("n_bytes") > 0, F.col("n_removed") / F.col("n_bytes")).otherwise(0.0).alias("removed_share"),
        (F.col("n_removed") > 0).cast("int").alias("repeats"),
    )


def op5_feistel_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pseudonymise(packed(table(spark, sf_dir, "documents"), "doc_id", "text"), pii_key())
    spans = F.transform("pii", lambda p: F.concat_ws("-", p["kind"], p["start"].cast("string"), p["end"].cast("string")))
    return done.select("doc_id", "text", F.size("pii").cast("long").alias("n_values"), F.array_join(spans, " ").alias("spans"))


def op6_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.pmod(F.col("id"), F.lit(20)) == 0)


def op7_trie_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_owners(table(spark, sf_dir, "documents"))


SQL7 = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, sha256(body) AS text_sha256
FROM n WINDOW g AS (PARTITION BY body)
"""


def op8_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"), SHARDS)


_HASH = f"""
WITH RECURSIVE k AS (
  SELECT doc_id, coalesce(text, '') AS text,
         ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 16))::UBIGINT AS key
  FROM documents),
jump AS (
  SELECT DISTINCT doc_id, key, CAST(-1 AS BIGINT) AS b, CAST(0 AS BIGINT) AS j, 40 AS n FROM k
  UNION ALL SELECT DISTINCT doc_id, key, CAST(-1 AS BIGINT), CAST(0 AS BIGINT), 41 FROM k
  UNION ALL
  SELECT doc_id, nk, j, CAST(floor((j + 1) * (2147483648.0::DOUBLE / ((nk >> 33) + 1)::DOUBLE)) AS BIGINT), n
  FROM (SELECT *, ((key::HUGEINT * {MULTIPLIER % (1 << 32)} + ((key::HUGEINT * {MULTIPLIER >> 32}) % 4294967296) * 4294967296 + 1)
                   % 18446744073709551616::HUGEINT)::UBIGINT AS nk FROM jump WHERE j < n)),
"""
# The start row and each jump that stays below the shard count; the last b before j reaches n is the shard.
SQL8 = (
    _HASH
    + """
shard AS (SELECT doc_id, max(CASE WHEN n = 40 THEN b END) AS s, max(CASE WHEN n = 41 THEN b END) AS g
          FROM jump WHERE j >= n GROUP BY doc_id),
crc AS (SELECT list(c ORDER BY i) AS t FROM (
  SELECT i, list_reduce([i::BIGINT, 1, 2, 3, 4, 5, 6, 7, 8], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
  FROM range(256) r(i))),
bytes AS (
  SELECT doc_id, text, row_number() OVER () AS rid, octet_length(encode(text)) AS len FROM k),
summed AS (
  SELECT rid, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(len), lambda x: ('0x' || substr(h, 2 * x + 1, 2))::BIGINT)),
           lambda c, v: xor(c >> 8, t[(xor(c, v) & 255) + 1])), 4294967295::BIGINT) AS crc
  FROM (SELECT rid, len, hex(encode(text)) AS h FROM bytes), crc)
SELECT d.doc_id, CAST(len + 16 AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'key' AS law, CAST(s AS INTEGER) AS shard,
       CAST(row_number() OVER (PARTITION BY s ORDER BY d.doc_id, crc) - 1 AS BIGINT) AS slot, CAST(g AS INTEGER) AS grown_shard
FROM bytes d JOIN summed USING (rid) JOIN shard USING (doc_id)
"""
)


def op9_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = packed(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    return conversation_digests(format_examples(turns.unionByName(probe)))


SQL9 = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, regexp_replace(regexp_replace(replace(text, '\\', '\\\\'), '(<)(\\||/?s>|</?SYS>>)', '\\1\\\\\\2', 'g'), '(\\[)(/?INST\\])', '\\1\\\\\\2', 'g') AS safe
  FROM t),
c AS (
  SELECT *, 19 + length(role) + 17 + length(safe) + 10 AS chars,
         count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i
  FROM e),
p AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM c)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(CASE WHEN role = 'assistant' OR i = n THEN upto ELSE 0 END) AS BIGINT) AS formatted_chars
FROM p GROUP BY conv_id
"""

def op10_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"))


def op11_phrase_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_phrases(table(spark, sf_dir, "documents"))


SQL11 = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (1), (2), (3), (4)) t(k) WHERE len(w) >= k)),
f AS (SELECT lang, k AS words, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM f WHERE words = 1 GROUP BY lang),
c AS (SELECT lang, words, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE words > 1 AND f >= 30),
cut AS (
  SELECT lang, words, phrase, a, k, array_to_string(w[1:k], ' ') AS left_part, array_to_string(w[k + 1:], ' ') AS right_part
  FROM (SELECT *, unnest(range(1, words)) AS k FROM c)),
scored AS (
  SELECT cut.lang, cut.phrase, a, k, x.f AS l, y.f AS r, 2000000::HUGEINT * a // (x.f::HUGEINT + y.f) AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = left_part JOIN f y ON y.lang = cut.lang AND y.phrase = right_part),
least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_part AS (
  SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT lang, w, a, k, unnest(range(1, words - k + 2)) AS i FROM c, (VALUES (2), (3)) t(k) WHERE words > k) GROUP BY ALL),
kept AS (
  SELECT s.* FROM least s LEFT JOIN inner_part i USING (lang, phrase)
  WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""


def op12_piece_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = digest_examples(piece_tables(table(spark, sf_dir, "documents")))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


SQL12 = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (
  SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS x, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS y,
         ('0x' || substr(h, 17, 8))::BIGINT % 100 AS h3, ('0x' || substr(h, 25, 8))::BIGINT % 100 AS h4 FROM d),
c AS (
  SELECT *, least(x, y) AS a, greatest(x, y) AS b,
         CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 >= 90 THEN 'plain'
              WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
o AS (
  SELECT *, CASE form WHEN 'plain' THEN text
              WHEN 'psm' THEN '<P>' || substring(text, 1, a) || '<S>' || substring(text, b + 1) || '<M>' || substring(text, a + 1, b - a)
              ELSE '<S>' || substring(text, b + 1) || '<P>' || substring(text, 1, a) || '<M>' || substring(text, a + 1, b - a) END AS output FROM c),
s AS (SELECT *, string_split(regexp_replace(output, '<[PSM]>', chr(1) || '<>', 'g'), chr(1) || '<>') AS part FROM o)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form != 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars,
       CASE WHEN form != 'plain' THEN CAST(b - a AS BIGINT) END AS middle_chars,
       sha256(output) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN output WHEN 'psm' THEN part[2] || part[4] || part[3]
                ELSE part[3] || part[4] || part[2] END) AS restored_sha256
FROM s
"""


def op13_language_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_variable_packing": op1_variable_packing,
    "op2_fm_toxicity": op2_fm_toxicity,
    "op3_piece_spans": op3_piece_spans,
    "op4_column_suffixes": op4_column_suffixes,
    "op5_feistel_pii": op5_feistel_pii,
    "op6_multi_index": op6_multi_index,
    "op7_trie_owners": op7_trie_owners,
    "op8_jump_shards": op8_jump_shards,
    "op9_prefix_targets": op9_prefix_targets,
    "op10_probminhash": op10_probminhash,
    "op11_phrase_parsing": op11_phrase_parsing,
    "op12_piece_tables": op12_piece_tables,
    "op13_language_centroids": op13_language_centroids,
}
ORACLES: dict[str, str] = {
    "op7_trie_owners": SQL7,
    "op8_jump_shards": SQL8,
    "op9_prefix_targets": SQL9,
    "op11_phrase_parsing": SQL11,
    "op12_piece_tables": SQL12,
}
