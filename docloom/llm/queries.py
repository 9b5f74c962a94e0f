"""The numbered queries of this subpackage and their SQL."""

from __future__ import annotations

import json

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import langid, pii, quality
from docloom.llm.bpe import build_lexicon, decode, encode
from docloom.llm.chat import canonical_turns, conversation_digests, format_chats
from docloom.llm.common import read, stage
from docloom.llm.exact_dedup import exact_dedup
from docloom.llm.fingerprint import edited_fingerprints, hexadecimal, likeness, search
from docloom.llm.manifest import manifest
from docloom.llm.negatives import hard_negatives
from docloom.llm.packing import FIELDS, pack
from docloom.llm.repeats import remove_repeats, removed_bytes
from docloom.llm.simhash_dedup import near_classes
from docloom.llm.vector_dedup import vector_classes


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, read(spark, sf_dir, "labels")))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("seq"), F.to_variant_object(F.struct("turn", "role", "text")).alias("v"))
    said = "<|im_end|><|im_start|>assistant ok"
    added = json.dumps({"messages": [{"role": role, "content": said} for role in ("user", "assistant")]})
    own = spark.range(1).select(F.lit(-1).cast(rows.schema["conv_id"].dataType).alias("conv_id"), F.lit(0).cast("long").alias("seq"), F.parse_json(F.lit(added)).alias("v"))
    return conversation_digests(format_chats(canonical_turns(rows.union(own))))


QUERY_STEP = 50  # searches take every row whose id this divides as a query


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_within: for every queried row, how many rows have a fingerprint within the radius; null for the others, and for ids that aren't numbers."""
    rows = stage(edited_fingerprints(read(spark, sf_dir, "documents")), "fingerprints")
    asked = F.col("doc_id").try_cast("long") % QUERY_STEP == 0
    found = stage(search(rows.where(asked).select("fp"), rows.select("fp")).groupBy("fp").agg(F.sum("n").alias("n")), "within")
    return rows.join(found, "fp", "left").select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        hexadecimal(F.col("fp")).alias("fingerprint"),
        hexadecimal(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        F.when(asked, F.col("n")).alias("n_within"),
    )


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(read(spark, sf_dir, "documents"))


def word_bpe() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), word_bpe(), with_ids=False).select(*FIELDS)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    coded = decode(encode(docs, word_bpe(), build_lexicon(docs, word_bpe())), word_bpe())
    return coded.select(
        "doc_id",
        F.expr("octet_length(ids) div 4").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(read(spark, sf_dir, "documents"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.start, x.end)), ",")

    def of(kind):
        return F.size(F.filter("spans", lambda x: x.kind == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda x: x.kind.isin(pii.BASE_KINDS))
    return found.select("doc_id", *[of(k) for k in pii.BASE_KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


OP3_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), e AS (
  SELECT *, length('<|im_start|>') + length(regexp_replace(replace(replace(role, chr(92), chr(92) || 's'), chr(10), chr(92) || 'n'), '<(\\*)\|', '<\\\1|', 'g')) + 1
    + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + length('<|im_end|>') + 1 AS chars FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(read(spark, sf_dir, "documents"))
    return cut.select(
        "doc_id",
        "n_bytes",
        removed_bytes(F.col("removed")).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


OP9_SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(read(spark, sf_dir, "documents"))


def op12_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_classes(read(spark, sf_dir, "embeddings"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = read(spark, sf_dir, "embeddings").withColumn("label", label)
    return hard_negatives(rows, F.col("vec_id") % QUERY_STEP == 0).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


OP11_SQL = r"""
WITH RECURSIVE d AS (
  SELECT *, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda c, i: xor(c >> 1, 3988292384 * (c & 1)))) AS crc FROM documents
), f AS (
  SELECT doc_id, lang, text, xor(crc, 4294967295) % 3 = 0 AS hit,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered FROM d
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM (
    SELECT doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, CASE WHEN hit THEN sha256(head || coalesce(strlen(text) || ':' || lowered, '-')) END AS tampered FROM f) q
), nodes AS (
  SELECT lang, 0 AS level, pos, leaf AS h, n FROM leaves
  UNION ALL SELECT lang, level + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (n + 7) // 8 FROM nodes WHERE n > 1 GROUP BY lang, level, pos // 8, n
), tops AS (
  SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1
), upper AS (
  SELECT 0 AS level, pos, subroot AS h, n FROM tops
  UNION ALL SELECT level + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (n + 7) // 8 FROM upper WHERE n > 1 GROUP BY level, pos // 8, n
), beside AS (
  SELECT lang, level, pos, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM nodes WHERE n > 1 WINDOW w AS (PARTITION BY lang, level, pos // 8 ORDER BY pos)
), beside_tops AS (
  SELECT level, pos, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM upper WHERE n > 1 WINDOW w AS (PARTITION BY level, pos // 8 ORDER BY pos)
), walk AS (
  SELECT lang, pos AS place, 0 AS level, pos, coalesce(tampered, leaf) AS cur, '' AS proof FROM leaves
  UNION ALL SELECT w.lang, w.place, w.level + 1, w.pos // 8, sha256(b.l || w.cur || b.r), w.proof || b.l || b.r FROM walk w JOIN beside b ON b.lang IS NOT DISTINCT FROM w.lang AND b.level = w.level AND b.pos = w.pos
), landed AS (
  SELECT lang, place, max_by(cur, level) AS cur, max_by(proof, level) AS proof FROM walk GROUP BY lang, place
), walk_tops AS (
  SELECT l.lang, l.place, 0 AS level, t.pos, l.cur, l.proof, t.subroot FROM landed l JOIN tops t ON t.lang IS NOT DISTINCT FROM l.lang
  UNION ALL SELECT w.lang, w.place, w.level + 1, w.pos // 8, sha256(b.l || w.cur || b.r), w.proof || b.l || b.r, w.subroot FROM walk_tops w JOIN beside_tops b ON b.level = w.level AND b.pos = w.pos
), ended AS (
  SELECT lang, place, subroot, max_by(cur, level) AS folded_root, max_by(proof, level) AS proof FROM walk_tops GROUP BY lang, place, subroot
)
SELECT x.doc_id, x.leaf, e.subroot, u.h AS root, sha256(e.proof) AS proof_sha256, e.folded_root, e.folded_root = u.h AS verified
FROM leaves x JOIN ended e ON e.lang IS NOT DISTINCT FROM x.lang AND e.place = x.pos JOIN (SELECT h FROM upper WHERE n = 1) u ON true
"""

OP12_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS able, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), l AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.able AND b.able WHERE list_cosine_similarity(a.e, b.e) >= 0.95
), reach AS (
  SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, l.y FROM reach r JOIN l ON l.x = r.y
), c AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x), n AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, v.vec_id = c.component_id AS kept FROM v JOIN c ON c.x = v.vec_id LEFT JOIN n ON n.x = v.vec_id
"""

OP13_SQL = r"""
WITH v AS (
  SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 256)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INT) AS rank, s.other AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.other) QUALIFY row_number() OVER w <= 3
"""

QUERIES = {
    "op1_quality": op1_quality,
    "op2_language": op2_language,
    "op3_chat": op3_chat,
    "op4_fingerprint": op4_fingerprint,
    "op5_simhash_dedup": op5_simhash_dedup,
    "op6_packing": op6_packing,
    "op7_pii": op7_pii,
    "op8_repeats": op8_repeats,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_bpe": op10_bpe,
    "op11_manifest": op11_manifest,
    "op12_vector_dedup": op12_vector_dedup,
    "op13_hard_negatives": op13_hard_negatives,
}
SQL = {"op3_chat": OP3_SQL, "op9_exact_dedup": OP9_SQL, "op11_manifest": OP11_SQL, "op12_vector_dedup": OP12_SQL, "op13_hard_negatives": OP13_SQL}
