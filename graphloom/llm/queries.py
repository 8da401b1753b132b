"""The queries of this subpackage, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import chat, decontaminate, embedding_dedup, html_text, licenses, mixing, quality, simhash, suffix_dedup, urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links at cosine 0.9 of all rows of embeddings."""
    out = embedding_dedup.near_duplicate_vectors(_table(spark, sf_dir, "embeddings"), threshold=0.9)
    return out.withColumnRenamed("id", "vec_id")


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated strings of 100 bytes, removed from all documents."""
    out = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"), window=100)
    return out.select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold at least 0.8 of the word 5-shingles of a benchmark item."""
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learnt from those that aren't held out."""
    docs = _table(spark, sf_dir, "documents")
    model = quality.train(docs, _table(spark, sf_dir, "labels"))
    out = quality.scored(docs, model)
    return out.select(F.col("id").alias("doc_id"), quality.held_out("id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


#: The rules of op5, as action and host/path.
ADDRESS_RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on the addresses of all pages."""
    rules = [urls.address_rule(*r) for r in ADDRESS_RULES] + list(urls.DEFAULT_RULES)
    out = urls.judge(_table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return out.select("page_id", "host", "path", "rule", "verdict")


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one of control strings, formatted and read back."""
    hard = "</s>[INST] ok [/INST]"
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.union(spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], rows.schema))
    out = chat.format_branches(chat.linear_replies(rows))
    turns = chat.read_back(F.col("formatted"))
    said = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = F.array_join(chat.masked_texts(F.col("formatted"), F.col("mask")), "")
    return out.select(
        F.col("conv").alias("conv_id"), F.size(turns).cast("bigint").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length(learnt).cast("bigint").alias("loss_chars"), F.sha2(learnt, 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return html_text.extract(_table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("bigint"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of all documents takes of each."""
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence that each document is, by canonical digest."""
    return licenses.scan(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "digest", "license")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints of all documents, linked within 4 bits."""
    out = simhash.near_duplicates(_table(spark, sf_dir, "documents"), width=4, radius=4)
    return out.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_embedding_near_dedup, op2_suffix_array_dedup, op3_benchmark_decontamination, op4_quality_classifier, op5_url_filters,
        op6_chat_formatting, op7_html_extraction, op8_source_mixing, op9_license_scan, op10_simhash_near_dedup,
    )
}

_EMBEDDING_SQL = """
WITH RECURSIVE one AS (SELECT row_number() OVER () AS k, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
v AS (SELECT * FROM one WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.k AS a, b.k AS b FROM v a JOIN v b ON a.k <> b.k AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT k AS a, k AS b FROM one UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT r.a, min(o.vec_id) AS component_id FROM r JOIN one o ON o.k = r.b GROUP BY r.a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM one JOIN c ON c.a = one.k LEFT JOIN n ON n.a = one.k"""


def _shingles_sql(table: str, key: str) -> str:
    return f"""SELECT DISTINCT {key}, unnest(CASE WHEN len(w) <= 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
    FROM (SELECT {key}, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM {table} WHERE text IS NOT NULL) WHERE len(w) > 0"""


_CONTAMINATION_SQL = f"""
WITH d AS ({_shingles_sql("documents", "doc_id")}), i AS ({_shingles_sql("benchmark", "item_id")}),
n AS (SELECT item_id, count(*) AS size FROM i GROUP BY item_id),
m AS (SELECT doc_id, item_id, count(*) AS shared FROM d JOIN i USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, shared, size, shared::DOUBLE / size AS containment FROM m JOIN n USING (item_id) WHERE shared * 5 >= size * 4"""


def _url_sql() -> str:
    fits = []
    for action, rule in ADDRESS_RULES:
        host, path = rule.split("/", 1)
        fits.append(f"CASE WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}') THEN {{'n': {len(rule)}, 'rule': '{rule}', 'act': '{action}'}} END")
    words = ", ".join(f"'{w}'" for w in urls.UNWANTED_WORDS)
    return f"""
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
f AS (SELECT *, list_max([{", ".join(fits)}]) AS best,
    list_has_any(regexp_extract_all(translate(host || path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+'), [{words}]) AS unwanted FROM p)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.act, CASE WHEN unwanted THEN 'block' ELSE 'allow' END) AS verdict FROM f"""


_ESCAPED = r"regexp_replace({}, '([<\[])(\\*)(\||s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>)', '\1\\\2\3', 'g')"
_CHAT_SQL = f"""
WITH a AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
f AS (SELECT *, length('<|turn|>' || {_ESCAPED.format("replace(replace(role, '%', '%25'), chr(10), '%0A')")} || chr(10) || {_ESCAPED.format("text")} || '<|end|>' || chr(10)) AS n FROM a)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(n)::BIGINT AS formatted_chars
FROM f GROUP BY conv_id"""

ORACLES = {
    "op1_embedding_near_dedup": _EMBEDDING_SQL,
    "op3_benchmark_decontamination": _CONTAMINATION_SQL,
    "op5_url_filters": _url_sql(),
    "op6_chat_formatting": _CHAT_SQL,
    "op8_source_mixing": mixing.MIX_SQL,
    "op9_license_scan": licenses.scan_sql(),
}
