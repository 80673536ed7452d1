"""One query per operator over its whole table, and SQL twins where SQL can say it."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm import conversation_repair, filter_audit, hpylm, jaccard_join, langid, packing_kk, quality_ledger, simhash_anchor, spbpe, token_records, token_spans, topk_pivot, twins, warc_zstd


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_topk_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best other vectors for every vector whose id is divisible by 50."""
    return topk_pivot.top_k(_table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5)


def op2_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record as read back from the dictionary-compressed archives."""
    return warc_zstd.write_and_read(_table(spark, sf_dir, "pages")).drop("content")


def op3_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place and ids in the record files, read back from them."""
    docs = _table(spark, sf_dir, "documents")
    return token_records.write_and_read(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op4_packing_kk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every piece of every document lies in the packed sequences."""
    docs = _table(spark, sf_dir, "documents")
    return packing_kk.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=1, capacity=2048)


def op5_simhash_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and the smallest document reachable by near-duplicate links."""
    rows = simhash_anchor.near_duplicates(_table(spark, sf_dir, "documents"), threshold=2)
    return rows.select("doc_id", simhash_anchor.hexadecimal("fp").alias("fingerprint"), "component_id")


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from the labelled ones outside the fold."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", langid.held_out("doc_id"))
    model = langid.fit(docs.filter("NOT held_out").select(F.col("doc_id").alias("key"), "text", "lang"))
    return langid.predict(docs.select("doc_id", "held_out", "text"), model).drop("text")


def op7_token_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document, from one encoding of each document."""
    return token_spans.by_lines(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements, failure bits and the verdict of policy v1 for every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = quality_ledger.ledger(docs)
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~quality_ledger.passes("base")).alias("base_failed"),
        quality_ledger.passes("v1").alias("kept"),
        "failures",
    )


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of policy v1 rejects, rejects alone, and what the policy would keep without it."""
    return quality_ledger.ablation(quality_ledger.ledger(_table(spark, sf_dir, "documents")), "v1")


def op9_hpylm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score under the model and under add-one word counts."""
    docs = _table(spark, sf_dir, "documents")
    return hpylm.train_and_score(docs.select("doc_id", "text", langid.held_out("doc_id", 7, 2).alias("held_out")))


def op10_sentencepiece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the bytes they decode to."""
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    rows = spbpe.decode(spbpe.encode(_table(spark, sf_dir, "documents"), path, pattern), path, pattern)
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and the digest of the repaired turns of every damaged conversation."""
    rows = conversation_repair.damaged(_table(spark, sf_dir, "conversations"))
    made = conversation_repair.repair(rows, dropped="dropped", lines=False)
    return made.select(F.col("key").cast("long").alias("conv_id"), *conversation_repair.TOTALS, "audit", F.col("sha256").alias("repaired_sha256"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters does at each step of all their orders, by source."""
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of four-word shingles and its component under Jaccard >= 0.85."""
    return jaccard_join.components_of(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_topk_pivot": op1_topk_pivot,
    "op2_warc_zstd": op2_warc_zstd,
    "op3_token_records": op3_token_records,
    "op4_packing_kk": op4_packing_kk,
    "op5_simhash_anchor": op5_simhash_anchor,
    "op6_langid": op6_langid,
    "op7_token_spans": op7_token_spans,
    "op8_quality_ledger": op8_quality_ledger,
    "quality_ablation": quality_ablation,
    "op9_hpylm": op9_hpylm,
    "op10_sentencepiece_bpe": op10_sentencepiece_bpe,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_filter_audit": op12_filter_audit,
    "op13_jaccard_join": op13_jaccard_join,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op1_topk_pivot": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = len(embedding)),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.x::DOUBLE[], c.x::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.x) = len(q.x) WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 5
""",
    "op2_warc_zstd": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
f AS (SELECT hex, min(page_id) AS first FROM p GROUP BY hex),
b AS (SELECT p.*, first, list_transform(range(8), lambda i: ('0x' || substr(p.hex, (5 * i + 1)::INT, 5))::BIGINT) AS v
      FROM p JOIN f ON f.hex = p.hex)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
       array_to_string(list_transform(v, lambda x: array_to_string(list_transform([32768, 1024, 32, 1],
           lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x // s) % 32 + 1)::INT, 1)), '')), '') AS payload_digest,
       CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to
FROM b
""",
    "op8_quality_ledger": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
win AS (
  SELECT r, i, w[i:i + 4] AS k FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
rep AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM win) WHERE c > 1),
covered AS (
  SELECT r, sum(least(5, coalesce(nxt - i, 5))) AS n
  FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM rep) GROUP BY r),
m AS (
  SELECT d.r, doc_id, len(w)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) -
         len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_dup_lines,
         coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN covered c ON c.r = d.r),
f AS (
  SELECT *, n_words < 10 AS f0, 100 * n_repeat_words > 20 * n_words AS f1, word_chars > 15 * n_words AS f2,
         2 * word_chars < 4 * n_words AS f3, 10 * n_symbols > word_chars AS f4,
         n_dup_lines > 3 AND 5 * n_dup_lines > n_words AS f5
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words,
       f0 OR f1 AS base_failed, NOT (f0 OR f1 OR f2 OR f3 OR f4 OR f5) AS kept,
       (f0::BIGINT + 2 * f1::BIGINT + 4 * f2::BIGINT + 8 * f3::BIGINT + 16 * f4::BIGINT + 32 * f5::BIGINT)::BIGINT AS failures
FROM f
""",
    "op11_conversation_repair": twins.CONVERSATION_REPAIR,
    "op12_filter_audit": twins.FILTER_AUDIT,
    "op13_jaccard_join": twins.JACCARD_JOIN,
}

_FAILS = [f"f{bit}" for bit in quality_ledger.RULE_BITS.values()]
#: The flags of op8's twin, counted by rule.
ORACLES["quality_ablation"] = ORACLES["op8_quality_ledger"].rsplit("SELECT doc_id, n_words", 1)[0] + " UNION ALL ".join(
    f"SELECT '{rule}' AS rule, count(*) FILTER (WHERE f{bit}) AS n_failed, count(*) FILTER (WHERE f{bit} AND NOT ({others})) AS n_failed_alone, count(*) FILTER (WHERE NOT ({' OR '.join(_FAILS)})) AS n_kept, count(*) FILTER (WHERE NOT ({others})) AS n_kept_without FROM f"
    for rule, bit in quality_ledger.RULE_BITS.items()
    for others in [" OR ".join(f for f in _FAILS if f != f"f{bit}")]
)
