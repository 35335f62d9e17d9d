"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from actorlens.llm import (
    alignment,
    bpe,
    fingerprints,
    jaccard,
    line_dedup,
    mixing,
    pii,
    positional,
    quality,
    resampling,
    substring_dedup,
    url_rules,
    vectors,
)

Query = Callable[[SparkSession, str], DataFrame]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    learned = ~quality.held_out()
    model = quality.train(docs, labels.filter((F.col("quality") == 1) & learned), learned)
    return model.score(docs).select(
        "doc_id",
        quality.held_out().alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per passage that an earlier document holds, too."""
    marked = substring_dedup.mark_passages(read(spark, sf_dir, "documents"))
    return marked.select("doc_id", F.explode("repeats").alias("r")).select(
        "doc_id",
        "r.first_doc_id",
        "r.start",
        "r.stop",
        F.sha2("r.passage", 256).alias("passage_sha256"),
    )


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.encode(read(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return bpe.decode(encoded, path, public_tokenizers.PATTERN).select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_vector_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(read(spark, sf_dir, "embeddings"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_likeness(read(spark, sf_dir, "documents"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "rate"
    )


URL_RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.judge(read(spark, sf_dir, "pages"), rules)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_components(read(spark, sf_dir, "documents"))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(read(spark, sf_dir, "documents"))

    def count(number: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == number)).cast("bigint")

    return found.select(
        "doc_id",
        *[count(i + 1).alias(f"n_{kind}") for i, kind in enumerate(pii.KINDS)],
        F.sha2(pii.as_text(F.col("base")), 256).alias("base_sha256"),
        pii.as_text(F.col("spans")).alias("spans"),
    )


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches: the second one looks its lines up in the filters of the first."""
    docs = read(spark, sf_dir, "documents")
    batch = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(2)) == 0
    index = line_dedup.LineIndex.create(spark).insert(docs.filter(batch)).insert(docs.filter(~batch))
    return index.kept(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.alignment(read(spark, sf_dir, "documents"), *paths)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resampling.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = positional.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


BLANK = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP4_SQL = """
WITH RECURSIVE usable AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b
  ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.95),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a),
tops AS (SELECT a, min(b) AS top FROM reach GROUP BY a)
SELECT e.vec_id, coalesce(d.n, 0) AS n_links, least(e.vec_id, coalesce(t.top, e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, coalesce(t.top, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN degree d ON e.vec_id = d.a LEFT JOIN tops t ON e.vec_id = t.a
"""

OP7_SQL = f"""
WITH cut AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
rules(rule_host, rule_path, said) AS (VALUES
  {', '.join(str(rule) for rule in URL_RULES)}),
ranked AS (
  SELECT c.*, r.rule_host || r.rule_path AS rule, r.said,
         row_number() OVER (PARTITION BY page_id ORDER BY length(r.rule_host || r.rule_path) DESC, length(r.rule_host) DESC) AS place
  FROM cut c LEFT JOIN rules r
    ON (c.host = r.rule_host OR ends_with(c.host, '.' || r.rule_host)) AND starts_with(c.path, r.rule_path))
SELECT page_id, host, path, rule, coalesce(said, 'allow') AS verdict FROM ranked WHERE place = 1
"""

OP10_SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (SELECT *, translate(trim(line, {BLANK}), '{UPPER}', '{LOWER}') AS key FROM lines),
shared AS (
  SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) > 1),
marked AS (
  SELECT k.doc_id, k.line, k.pos, s.first IS NOT NULL AND k.doc_id > s.first AS gone
  FROM keyed k LEFT JOIN shared s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

#: Words of op12 and op13: what is left when all else becomes white space, A-Z lower-cased.
WORDS = f"""regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"""

OP12_SQL = f"""
WITH bits AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
cut AS (
  SELECT 0 AS part, doc_id, text, {WORDS} AS w FROM documents
  UNION ALL SELECT 1, item_id, text, {WORDS} FROM benchmark),
numbered AS (SELECT row_number() OVER () AS ref, * FROM cut),
features AS (
  SELECT ref, part, unnest(w) AS f FROM numbered
  UNION ALL SELECT ref, part, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM numbered),
counted AS (SELECT ref, part, f, count(*) AS n FROM features GROUP BY ALL),
named AS (
  SELECT f, list_transform(range(octet_length(encode(f))),
    lambda i: ('0x' || substr(hex(encode(f)), 2 * i + 1, 2))::BIGINT) AS bytes
  FROM (SELECT DISTINCT f FROM counted)),
hashed AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS b
  FROM named, bits),
held AS (SELECT ref, part, b, sum(n) AS n FROM counted JOIN hashed USING (f) GROUP BY ALL),
buckets AS (
  SELECT b, coalesce(sum(n) FILTER (part = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (part = 1), 0)::DOUBLE AS t FROM held GROUP BY b),
gains AS (
  SELECT b, floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000))))::BIGINT AS gain FROM buckets),
weights AS (SELECT ref, floor(sum(n * gain) / sum(n))::BIGINT AS weight FROM held JOIN gains USING (b) WHERE part = 0 GROUP BY ref),
scored AS (
  SELECT c.ref, c.doc_id, len(w) AS n_words, greatest(2 * len(w) - 1, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('7:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5) / 4294967296.0)))::BIGINT AS score
  FROM numbered c LEFT JOIN weights x ON c.ref = x.ref WHERE part = 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place,
         count(*) FILTER (n_words >= 20) OVER () AS eligible FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= eligible * 25 // 100 THEN place END AS rank
FROM ranked
"""

OP13_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS ref, doc_id, {WORDS} AS w FROM documents),
items AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {WORDS} AS w FROM benchmark),
cut AS (
  SELECT item, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS s FROM items WHERE len(w) > 0),
phrases AS (SELECT DISTINCT item, n, array_to_string(w[s : s + n - 1], ' ') AS phrase FROM cut),
places AS (
  SELECT ref, w, k.n, unnest(range(1, len(w) - k.n + 2)) AS s
  FROM docs, (SELECT DISTINCT n FROM phrases) k WHERE len(w) >= k.n),
met AS (
  SELECT DISTINCT p.ref, p.s, p.n, x.item
  FROM (SELECT ref, s, n, array_to_string(w[s : s + n - 1], ' ') AS phrase FROM places) p JOIN phrases x ON p.n = x.n AND p.phrase = x.phrase),
hit AS (SELECT ref, count(DISTINCT spot) AS n_hit FROM (SELECT ref, unnest(range(s, s + n)) AS spot FROM met) GROUP BY ref),
named AS (SELECT ref, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT ref, item FROM met) GROUP BY ref)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit ON docs.ref = hit.ref LEFT JOIN named ON docs.ref = named.ref
"""

QUERIES: dict[str, Query] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_vector_near_dedup": op4_vector_near_dedup,
    "op5_fingerprints": op5_fingerprints,
    "op6_source_mixing": op6_source_mixing,
    "op7_url_rules": op7_url_rules,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_personal_data": op9_personal_data,
    "op10_line_dedup": op10_line_dedup,
    "op11_tokenizer_alignment": op11_tokenizer_alignment,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_benchmark_decontamination": op13_benchmark_decontamination,
}

SQL: dict[str, str] = {
    "op4_vector_near_dedup": OP4_SQL,
    "op7_url_rules": OP7_SQL,
    "op10_line_dedup": OP10_SQL,
    "op12_importance_resampling": OP12_SQL,
    "op13_benchmark_decontamination": OP13_SQL,
}
