"""The operators of this folder as queries over the tables, and their SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chunk_dedup, common, filter_audit, hilbert_ann, importance, jaccard_join, langid, mixing, packing, quality_classifier, quality_rules, simhash, suffix_dedup, warc

load = common.load


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(load(spark, sf_dir, "documents"))


def op2_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix_sources(load(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "mix_tokens", "mix_epoch", "mix_block", "mix_block_key", "mix_doc_key")


def op3_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.fresh_path(spark, "warc")
    warc.write_archives(load(spark, sf_dir, "pages"), path)
    captures = warc.assemble(warc.read_records(spark, path))
    r = F.col("response")
    # A response has its payload in the archive; a revisit has the size and digest that its header states.
    stored = r["type"] == "response"
    size = F.when(stored, F.octet_length(r["payload"])).otherwise(r["declared_bytes"]).cast("long")
    return captures.select(
        r["page_id"].alias("page_id"), size.alias("payload_bytes"), F.when(stored, r["payload_sha1"]).otherwise(r["digest"]).alias("payload_digest"), r["type"].alias("record_type"), r["refers_to_page"].alias("refers_to"),
        r["uri"].alias("uri"), F.col("request").isNotNull().alias("has_request"), F.col("metadata").isNotNull().alias("has_metadata"),
    )


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_join.near_duplicates(docs).select("doc_id", "n_shingles", "component_id")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.learn_and_identify(load(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op7_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chunk_dedup.dedup_chunks(load(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.dedup_substrings(load(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load(spark, sf_dir, "documents"), tokenizer_path=tokenizer_path())


def op10_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_ann.nearest_neighbours(load(spark, sf_dir, "embeddings"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = importance.importance(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank", "n_words")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op13_simhash_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(load(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


#: mix_sources with its defaults: seed 17, blocks of 2**20 tokens, at most two repeats.
MIXING_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce('s' || source, 'n') AS src, coalesce(CAST(doc_id AS VARCHAR), '') AS ident,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS t FROM documents),
sz AS (SELECT src, CAST(sum(t) AS BIGINT) AS avail FROM d GROUP BY src),
p AS (SELECT src, ln(avail / CAST((SELECT sum(avail) FROM sz) AS DOUBLE)) AS lp FROM sz WHERE avail > 0),
ends AS (SELECT min(lp) AS low, max(lp) AS high FROM p),
bisection AS (
  SELECT 0 AS i, CAST(0 AS DOUBLE) AS lo, CAST(1 AS DOUBLE) AS hi
  UNION ALL
  SELECT i + 1, CASE WHEN exp(((lo + hi) / 2 - 1) * (low - high)) > 2.0 THEN (lo + hi) / 2 ELSE lo END,
         CASE WHEN exp(((lo + hi) / 2 - 1) * (low - high)) > 2.0 THEN hi ELSE (lo + hi) / 2 END
  FROM bisection, ends WHERE i < 30),
plan AS (
  SELECT sz.src, CASE WHEN avail > 0 THEN CAST(floor(avail * exp((lp - high) * (hi - 1))) AS BIGINT) ELSE 0 END AS budget, avail,
         greatest(1, CAST(ceil(avail / 1048576.0) AS BIGINT)) AS blocks
  FROM sz LEFT JOIN p USING (src), ends, (SELECT hi FROM bisection WHERE i = 30)),
rows_ AS (
  SELECT d.*, CASE WHEN avail > 0 THEN budget // avail ELSE 1 END AS epochs, CASE WHEN avail > 0 THEN budget % avail ELSE 0 END AS rest,
         CAST('0x' || substr(md5('17:' || ident), 1, 12) AS BIGINT) % blocks AS block
  FROM d JOIN plan USING (src)),
keyed AS (SELECT *, md5(concat_ws(':', '17', src, epochs, block)) AS bkey, md5(concat_ws(':', '17', epochs, ident)) AS dkey FROM rows_),
taken AS (SELECT *, epochs + CASE WHEN rest > 0 AND sum(t) OVER (PARTITION BY src ORDER BY bkey, block, dkey RANGE UNBOUNDED PRECEDING) <= rest THEN 1 ELSE 0 END AS n FROM keyed),
dealt AS (SELECT *, unnest(range(0, n)) AS e FROM taken)
SELECT doc_id, source, t AS mix_tokens, CAST(e AS INTEGER) AS mix_epoch, block AS mix_block,
       md5(concat_ws(':', '17', src, e, block)) AS mix_block_key, md5(concat_ws(':', '17', e, ident)) AS mix_doc_key
FROM dealt
"""


#: importance with its defaults. CRC-32 is folded over the bytes of each distinct word.
IMPORTANCE_SQL = r"""
WITH crc AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda r, k: xor(r >> 1, CASE WHEN r & 1 = 1 THEN 3988292384 ELSE 0 END)) ORDER BY i) AS t FROM range(256) x(i)),
low AS (
  SELECT 'd' AS side, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents
  UNION ALL SELECT 'b', NULL, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
word AS (SELECT side, doc_id, unnest(regexp_extract_all(body, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM low),
seen AS (SELECT side, doc_id, w, CAST(count(*) AS BIGINT) AS c FROM word GROUP BY ALL),
bytes AS (SELECT w, list_transform(range(length(hex(w)) // 2), lambda i: CAST('0x' || substr(hex(w), 2 * i + 1, 2) AS BIGINT)) AS b FROM (SELECT DISTINCT w FROM seen)),
bucket AS (SELECT w, xor(list_reduce(list_prepend(4294967295, b), lambda r, x: xor(r >> 8, crc.t[(xor(r, x) & 255) + 1])), 4294967295) % 10000 AS k FROM bytes, crc),
counts AS (SELECT k, sum(CASE WHEN side = 'd' THEN c ELSE 0 END) AS s, sum(CASE WHEN side = 'b' THEN c ELSE 0 END) AS t FROM seen JOIN bucket USING (w) GROUP BY k),
gain AS (
  SELECT k, CAST(floor(1000 * ln(((CAST(t AS DOUBLE) + 1) * (sum(s) OVER () + 10000)) / ((CAST(s AS DOUBLE) + 1) * (sum(t) OVER () + 10000)))) AS BIGINT) AS g FROM counts),
doc AS (SELECT doc_id, CAST(sum(c) AS BIGINT) AS n, CAST(floor(CAST(sum(c * g) AS DOUBLE) / sum(c)) AS BIGINT) AS weight FROM seen JOIN bucket USING (w) JOIN gain USING (k) WHERE side = 'd' GROUP BY doc_id),
scored AS (
  SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5) / 4294967296.0))) AS BIGINT) AS score
  FROM documents LEFT JOIN doc USING (doc_id)),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS r, count(*) OVER (PARTITION BY n_features >= 20) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND r <= 10 * n // 100 THEN r END AS rank, n_features AS n_words FROM placed
"""

#: audit with its default limits.
AUDIT_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS body FROM documents),
w AS (SELECT *, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY body) AS first FROM t),
m AS (
  SELECT doc_id, part,
         CASE WHEN len(words) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
       + CASE WHEN 100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 2 * length(body) THEN 4 ELSE 0 END
       + CASE WHEN regexp_matches(body, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN first < doc_id THEN 16 ELSE 0 END AS mask
  FROM w),
marked AS (SELECT part, mask, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS bad FROM m LEFT JOIN labels USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (bad) AS bad FROM marked GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS b),
o AS (
  SELECT p.x || q.x || r.x || s.x || u.x AS filter_order, [p.b, q.b, r.b, s.b, u.b] AS bits FROM l p, l q, l r, l s, l u
  WHERE len(list_distinct([p.x, q.x, r.x, s.x, u.x])) = 5),
st AS (SELECT filter_order, CAST(i AS INTEGER) AS step, bits[i] AS own, coalesce(list_sum(bits[1:i - 1]), 0)::INTEGER AS earlier FROM o, range(1, 6) x(i)),
r AS (
  SELECT part, filter_order, step, own, CAST(coalesce(sum(n) FILTER (mask & (own | earlier) = 0), 0) AS BIGINT) AS kept,
         CAST(coalesce(sum(n) FILTER (mask & own > 0 AND mask & earlier = 0), 0) AS BIGINT) AS removed,
         CAST(coalesce(sum(n) FILTER (mask & own > 0 AND mask & earlier > 0), 0) AS BIGINT) AS redundant,
         CAST(coalesce(sum(n) FILTER (mask = own), 0) AS BIGINT) AS unique_fails,
         CAST(coalesce(sum(good) FILTER (mask & own > 0 AND mask & earlier = 0), 0) AS BIGINT) AS good_lost,
         CAST(coalesce(sum(bad) FILTER (mask & own > 0 AND mask & earlier = 0), 0) AS BIGINT) AS toxic_lost
  FROM c, st GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_temperature_mixing": MIXING_SQL, "op11_importance_resampling": IMPORTANCE_SQL, "op12_filter_audit": AUDIT_SQL}
