"""The registered queries of this subpackage, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtrust.llm.common import documents
from fieldtrust.llm.decontaminate import contamination
from fieldtrust.llm.filter_audit import audit
from fieldtrust.llm.line_templates import without_recurring_lines
from fieldtrust.llm.minhash_dedup import near_duplicates
from fieldtrust.llm.packing import pack
from fieldtrust.llm.quality_fm import scored
from fieldtrust.llm.quality_rules import judged
from fieldtrust.llm.sharding import shard_rows
from fieldtrust.llm.simhash import simhash_groups
from fieldtrust.llm.token_count import count_tokens
from fieldtrust.llm.url_filter import judge, rule
from fieldtrust.llm.vector_codes import compressed
from fieldtrust.llm.warc import round_trip


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), width=3, percent=85)


#: The rule list of op2: verdict, host and path.
URL_RULES = [rule("allow", "org/"), rule("block", "example.org/es/"), rule("block", "example.org/en/1"), rule("allow", "com/fr/"), rule("block", "com/de/")]


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = count_tokens(documents(spark, sf_dir).select("doc_id", "text"), tokenizer_file("piece_bpe_32k.model"))
    return out.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").selectExpr("doc_id", "quality AS label")
    return scored(documents(spark, sf_dir).select("doc_id", "text"), labels).select("doc_id", "held_out", "score", "predicted")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(documents(spark, sf_dir)).drop("distance")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_recurring_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", "emptied", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return round_trip(spark, pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(documents(spark, sf_dir), shards=40)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compressed(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).drop("label")


def op13_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_url_filters": op2_url_filters,
    "op3_token_counts": op3_token_counts,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_decontamination": op5_decontamination,
    "op6_quality_rules": op6_quality_rules,
    "op7_packing": op7_packing,
    "op8_line_dedup": op8_line_dedup,
    "op9_warc": op9_warc,
    "op10_sharding": op10_sharding,
    "op11_filter_audit": op11_filter_audit,
    "op12_vector_codes": op12_vector_codes,
    "op13_simhash_dedup": op13_simhash_dedup,
}
#: The words of a text under the rules of op5, in SQL.
SQL_WORDS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"

#: One round of op12 in SQL: the nearest entries of all parts, then the entries' averages.
CODE_ROUND = """,
a{n} AS MATERIALIZED (SELECT id, part, d % 1000 AS entry, d // 1000 AS far FROM (SELECT id, part, min(1000 * s + entry) AS d FROM
    (SELECT id, v.part, entry, CAST(sum((x - c) * (x - c)) AS HUGEINT) AS s FROM v JOIN b{n} b ON v.part = b.part AND v.j = b.j GROUP BY ALL) GROUP BY id, part)),
b{m} AS MATERIALIZED (SELECT b.part, b.entry, b.j, coalesce(m.c, b.c) AS c FROM b{n} b LEFT JOIN
    (SELECT v.part, entry, j, CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS c FROM v JOIN a{n} a ON v.id = a.id AND v.part = a.part GROUP BY ALL) m
    ON b.part = m.part AND b.entry = m.entry AND b.j = m.j)"""

ORACLE_SQL: dict[str, str] = {
    "op11_filter_audit": """
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM t),
l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS bad FROM labels GROUP BY doc_id),
d AS (SELECT part, coalesce(good, false) AS good, coalesce(bad, false) AS bad,
      CASE WHEN len(words) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
      + CASE WHEN 100 * len(regexp_extract_all(text, '[A-Z]')) > 2 * length(text) THEN 4 ELSE 0 END
      + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN coalesce(w.doc_id > least, false) THEN 16 ELSE 0 END AS m
      FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
c AS (SELECT part, m, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (bad) AS bad FROM d GROUP BY part, m),
f(l, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT p.l || q.l || r.l || s.l || t.l AS filter_order, [p.b, q.b, r.b, s.b, t.b] AS bits FROM f p, f q, f r, f s, f t WHERE p.b + q.b + r.b + s.b + t.b = 31 AND len(list_distinct([p.b, q.b, r.b, s.b, t.b])) = 5),
k AS (SELECT filter_order, CAST(step AS INTEGER) AS step, bits[step] AS bit, coalesce(list_sum(bits[1 : step - 1]), 0) AS before FROM o, range(1, 6) x(step))
SELECT part, filter_order, step, CAST(coalesce(sum(n) FILTER (m & bit = 0 AND m & before = 0), 0) AS BIGINT) AS kept,
  CAST(coalesce(sum(n) FILTER (m & bit <> 0 AND m & before = 0), 0) AS BIGINT) AS removed, CAST(coalesce(sum(n) FILTER (m & bit <> 0 AND m & before <> 0), 0) AS BIGINT) AS redundant,
  CAST(coalesce(sum(n) FILTER (m = bit), 0) AS BIGINT) AS unique_fails, CAST(coalesce(sum(c.good) FILTER (m & bit <> 0 AND m & before = 0), 0) AS BIGINT) AS good_lost,
  CAST(coalesce(sum(c.bad) FILTER (m & bit <> 0 AND m & before = 0), 0) AS BIGINT) AS toxic_lost, CAST(coalesce(sum(n * 120 // greatest(bit_count(m), 1)) FILTER (m & bit <> 0), 0) AS BIGINT) AS shapley
FROM c, k GROUP BY part, filter_order, step
""",
    "op12_vector_codes": f"""
WITH e AS (SELECT row_number() OVER () AS id, vec_id, label, embedding FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS MATERIALIZED (SELECT id, (p - 1) // (n // 4) AS part, (p - 1) % (n // 4) AS j, CAST(floor(1024 * CAST(embedding[p] AS DOUBLE)) AS BIGINT) AS x FROM (SELECT id, embedding, len(embedding) AS n, unnest(range(1, len(embedding) + 1)) AS p FROM e)),
f AS (SELECT min(id) AS id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM e WHERE vec_id IS NOT NULL GROUP BY vec_id ORDER BY vec_id LIMIT 256),
b0 AS MATERIALIZED (SELECT part, entry, j, x AS c FROM v JOIN f ON v.id = f.id){"".join(CODE_ROUND.format(n=i, m=i + 1) for i in range(5))},
r AS (SELECT id, string_agg(lower(printf('%02x', CAST(entry AS INTEGER))), '' ORDER BY part) AS code, CAST(sum(far) AS BIGINT) AS error FROM a4 GROUP BY id),
h AS (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, entry, j)) AS codebooks_sha256 FROM b4)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM e JOIN r ON e.id = r.id, h
""",
    "op5_decontamination": f"""
WITH d AS (SELECT doc_id, {SQL_WORDS} AS w FROM documents),
i AS (SELECT item_id, {SQL_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[p : p + n - 1], ' ') AS win
       FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM i WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') AS win
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d CROSS JOIN (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
h AS (SELECT doc_id, dw.n, p, item_id FROM dw JOIN iw ON dw.win = iw.win AND dw.n = iw.n),
c AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS place FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
""",
    "op9_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
m AS (SELECT page_id, body, CASE WHEN strlen(body) >= 1000 THEN max(page_id) OVER (PARTITION BY body) ELSE page_id END AS last FROM p)
SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS payload_digest, CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to FROM m
""",
}
