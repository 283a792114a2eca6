"""The registered queries of this package and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.llm.alignment import align_tokenizers
from ledgerloom.llm.exact_dedup import exact_duplicates
from ledgerloom.llm.exact_topk import exact_topk
from ledgerloom.llm.html_content import extract_content
from ledgerloom.llm.importance import importance_draw
from ledgerloom.llm.jaccard_join import similar_components
from ledgerloom.llm.language_id import fit, held_out, identify
from ledgerloom.llm.learned_ann import ann_search
from ledgerloom.llm.mixing import mix_sources
from ledgerloom.llm.records import token_records
from ledgerloom.llm.sentencepiece_codec import piece_encode
from ledgerloom.llm.shared import table
from ledgerloom.llm.suffix_dedup import remove_repeats
from ledgerloom.llm.url_filter import filter_urls
from ledgerloom.llm.vectors import finite

URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def vocabulary(name: str) -> str:
    """Where this machine and its executors have the public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_learned_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return ann_search(rows, rows.filter("vec_id % 20 = 0"), 20)


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").filter(finite(F.col("embedding")))
    rows = rows.select("vec_id", F.transform("embedding", lambda x: F.floor(256 * x.cast("double"))).alias("vector"))
    return exact_topk(rows, rows.filter("vec_id % 50 = 0"), 5)


OP2_SQL = """
WITH v AS (SELECT DISTINCT vec_id, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
    WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * d.v[i]))::BIGINT AS score
    FROM v q JOIN v d ON q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id AND len(q.v) = len(d.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.filter(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op4_html_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_content(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return piece_encode(docs, model or vocabulary("piece_bpe_32k.model"), round_trip=True).select("doc_id", "n_tokens", F.xxhash64("ids").alias("ids_hash"), "parity", "round_trip")


def op6_token_records(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    return token_records(table(spark, sf_dir, "documents"), tokenizer or vocabulary("word_bpe_49k.json"), end_id=2)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), length=100)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(table(spark, sf_dir, "documents"), words=4, percent=85)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


OP9_SQL = r"""
WITH u AS (SELECT page_id, row_number() OVER () AS r,
    translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
rules(verdict, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
m AS (SELECT r, h || p AS rule, verdict, row_number() OVER (PARTITION BY r ORDER BY length(h || p) DESC, length(h) DESC) AS k
    FROM u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN (SELECT * FROM m WHERE k = 1) USING (r)
"""


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"), [3, 1, 2], share=1.5, max_epochs=2.0)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


OP10_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    md5('mix:' || coalesce(doc_id::VARCHAR, 'null')) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, list_extract([3.0::DOUBLE, 1.0, 2.0], ((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1)::INT) AS weight,
    1.5::DOUBLE * sum(source_size) OVER () AS mix, 2.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, (mix - coalesce(sum(cap) OVER (ORDER BY cap / weight, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, source IS NULL, encode(source) ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM w),
t AS (SELECT source, source_size, least(cap, weight * coalesce((SELECT arg_min(lev, cap / weight) FROM l WHERE lev * weight <= cap), 1e300)) AS target FROM l),
j AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS whole,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, round(target, 6) AS target,
    (whole * size + greatest(0, least(size, round(target - whole * source_size)::BIGINT - start)))::BIGINT AS taken FROM j
"""


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"), keep="largest")


OP11_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
    row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_draw(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=10, longest=1, buckets=10_000, min_words=20, seed="2024")


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str, a: str | None = None, b: str | None = None) -> DataFrame:
    return align_tokenizers(table(spark, sf_dir, "documents"), a or vocabulary("byte_bpe_50k.json"), b or vocabulary("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_learned_ann": op1_learned_ann, "op2_exact_topk": op2_exact_topk, "op3_language_id": op3_language_id, "op4_html_content": op4_html_content, "op5_sentencepiece": op5_sentencepiece, "op6_token_records": op6_token_records, "op7_suffix_dedup": op7_suffix_dedup, "op8_jaccard_join": op8_jaccard_join, "op9_url_filter": op9_url_filter, "op10_mix_sources": op10_mix_sources, "op11_exact_dedup": op11_exact_dedup, "op12_importance_resampling": op12_importance_resampling, "op13_tokenizer_alignment": op13_tokenizer_alignment}
ORACLE_SQL: dict[str, str] = {"op2_exact_topk": OP2_SQL, "op9_url_filter": OP9_SQL, "op10_mix_sources": OP10_SQL, "op11_exact_dedup": OP11_SQL}
