"""Text diagnostics and embedding geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.operators import vectors as V
from ledgerloom.plans.register import query
from ledgerloom.sources.tables import table


def documents(spark, d):
    return table(spark, d, "documents")


@query("t1_script_language", r"SELECT doc_id, CASE WHEN regexp_matches(substr(text, 1, 100), '[\x{3040}-\x{30FF}]') THEN 'ja' WHEN regexp_matches(substr(text, 1, 100), '\p{Han}') THEN 'zh' WHEN regexp_matches(substr(text, 1, 100), '\p{Arabic}') THEN 'ar' WHEN regexp_matches(substr(text, 1, 100), '\p{Cyrillic}') THEN 'ru' WHEN regexp_matches(substr(text, 1, 100), '\p{Devanagari}') THEN 'hi' ELSE 'en' END AS lang FROM documents")
def t1(spark, d):
    return documents(spark, d).select("doc_id", T.script_language(F.col("text")).alias("lang"))


@query("t2_script_share", r"SELECT doc_id, round(length(regexp_replace(text, '[^\p{Latin}]', '', 'g')) / nullif(length(regexp_replace(text, '[^\p{L}]', '', 'g')), 0), 9) AS share FROM documents")
def t2(spark, d):
    return documents(spark, d).select("doc_id", T.script_share(F.col("text"), "latin").alias("share"))


@query("t3_script_mismatch", r"SELECT lang, sum((length(text) >= 20 AND coalesce(length(regexp_replace(text, '[^\p{Cyrillic}]', '', 'g')) / nullif(length(regexp_replace(text, '[^\p{L}]', '', 'g')), 0) < 0.2, true))::INT)::BIGINT AS not_cyrillic FROM documents GROUP BY 1")
def t3(spark, d):
    return documents(spark, d).groupBy("lang").agg(F.count_if(T.script_mismatch(F.col("text"), "cyrillic")).alias("not_cyrillic"))


@query("t4_noise_rates", r"SELECT doc_id, round((length(text) - length(replace(text, chr(65533), ''))) / length(text), 9) AS replacement, round(length(regexp_replace(text, '[^\x{00}-\x{08}\x{0B}\x{0C}\x{0E}-\x{1F}\x{7F}-\x{9F}]', '', 'g')) / length(text), 9) AS control FROM documents WHERE length(text) > 0")
def t4(spark, d):
    c = F.col("text")
    return documents(spark, d).filter("length(text) > 0").select("doc_id", T.replacement_rate(c).alias("replacement"), T.control_rate(c).alias("control"))


@query("t5_word_ratio", r"WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+') AS w FROM documents) SELECT doc_id, len(w)::INT AS words, round(len(list_distinct(w)) / nullif(len(w), 0), 9) AS unique_ratio FROM w")
def t5(spark, d):
    return documents(spark, d).select("doc_id", F.size(T.words(F.col("text"))).alias("words"), T.unique_word_ratio(F.col("text")).alias("unique_ratio"))


@query("t6_repeated_trigrams", r"WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+') AS w FROM documents), g AS (SELECT doc_id, list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS g FROM w) SELECT doc_id, CASE WHEN len(g) > 0 THEN round(1 - len(list_distinct(g)) / len(g), 9) ELSE 0.0 END AS repeated FROM g")
def t6(spark, d):
    return documents(spark, d).select("doc_id", T.repeated_ngram_ratio(F.col("text"), 3).alias("repeated"))


@query("t7_repetition_loop", r"WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+') AS w FROM documents), g AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) AS g FROM w), c AS (SELECT doc_id, g, count(*) AS n FROM g GROUP BY ALL), l AS (SELECT doc_id, max(n) >= 4 AS l FROM c GROUP BY 1) SELECT doc_id, coalesce(l, false) AS loops FROM documents LEFT JOIN l USING (doc_id)")
def t7(spark, d):
    return documents(spark, d).select("doc_id", T.repetition_loop("text").alias("loops"))


@query("t8_echo_overlap", r"WITH t AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+')) AS w FROM conversations) SELECT a.conv_id, a.turn, round(len(list_intersect(a.w, b.w)) / nullif(len(a.w), 0), 9) AS echo FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1")
def t8(spark, d):
    c = table(spark, d, "conversations")
    reply = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    return c.join(reply, ["conv_id", "turn"]).select("conv_id", "turn", T.echo_overlap(F.col("text"), F.col("reply")).alias("echo"))


@query("t9_t10_form", r"""SELECT doc_id, round(length(regexp_replace(text, '[^\p{P}]', '', 'g')) / length(text), 9) AS punctuation, length(text) > 3500 AND NOT regexp_matches(rtrim(text), '[.!?…。！？।؟''"”’)\]]$') AS truncated FROM documents WHERE length(text) > 0""")
def t9(spark, d):
    c = F.col("text")
    return documents(spark, d).filter("length(text) > 0").select("doc_id", T.punctuation_rate(c).alias("punctuation"), T.truncation_suspect(c).alias("truncated"))


@query("t11_language_disagreement", r"SELECT lang, count(*) AS n, sum((lang IS NOT NULL AND lang <> CASE WHEN regexp_matches(text, '[ßäöü]') THEN 'de' ELSE lang END)::INT)::BIGINT AS disagree FROM documents GROUP BY 1")
def t11(spark, d):
    guess = F.when(F.col("text").rlike("[ßäöü]"), "de").otherwise(F.col("lang"))
    return documents(spark, d).groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("lang").isNotNull() & (F.col("lang") != guess)).alias("disagree"))


@query("t12_slug", r"WITH s AS (SELECT doc_id, text, regexp_replace(substr(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 48), '_+$', '') AS s FROM documents) SELECT doc_id, CASE WHEN s = '' THEN 'id_' || substr(sha1(text), 1, 10) ELSE s END AS slug FROM s")
def t12(spark, d):
    return documents(spark, d).select("doc_id", T.slug(F.col("text")).alias("slug"))


@query("t13_chunks")
def t13(spark, d):
    c = T.chunks(documents(spark, d).select("doc_id", "text"), "text", 3000)
    return c.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.max(F.length("chunk")).alias("longest"), F.sum(F.length("chunk")).alias("chars"))


@query("t14_collapse_distinct", r"SELECT count(DISTINCT trim(regexp_replace(regexp_replace(text, 'Licensed under [A-Z0-9 .-]+', '', 'g'), '[\s]+', ' ', 'g'))) AS texts FROM documents")
def t14(spark, d):
    return documents(spark, d).select(T.collapse(F.col("text"), "Licensed under [A-Z0-9 .-]+").alias("t")).agg(F.countDistinct("t").alias("texts"))


@query("t15_after_delimiter", r"SELECT page_id, trim(regexp_extract(url, '^[^:：︰﹕]*[:：︰﹕](.*)$', 1)) AS rest FROM pages")
def t15(spark, d):
    return table(spark, d, "pages").select("page_id", T.after_delimiter(F.col("url")).alias("rest"))


@query("t16_foreign", r"SELECT lang, sum((length(regexp_replace(text, '[^\p{L}]', '', 'g')) - length(regexp_replace(text, '[^\p{Latin}]', '', 'g')) > 0.25 * length(regexp_replace(text, '[^\p{Latin}]', '', 'g')))::INT)::BIGINT AS n FROM documents GROUP BY 1")
def t16(spark, d):
    return documents(spark, d).groupBy("lang").agg(F.count_if(T.foreign(F.col("text"))).alias("n"))


@query("t17_lenient_json", "SELECT event_id, (json_extract(props, '$.k'))::INT AS k FROM events")
def t17(spark, d):
    fenced = F.concat(F.lit("Sure:\n```json\n"), "props", F.lit("\n```"))
    return table(spark, d, "events").select("event_id", T.lenient_json(fenced, "k int")["k"].alias("k"))


@query("t18_t19_templates", "SELECT conv_id, turn, '<|system|>' || chr(10) || role || chr(10) || '<|user|>' || chr(10) || substr(text, 1, 1500) || chr(10) || '<|assistant|>' || chr(10) AS prompt FROM conversations")
def t18(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.chat(F.col("role"), F.substring("text", 1, 1500)).alias("prompt"))


@query("t20_two_step_lookup", "SELECT c_custkey, coalesce(b.c_name, a.c_name) AS resolved FROM customer a LEFT JOIN (SELECT c_custkey AS k, c_custkey + 1 AS target FROM customer WHERE c_custkey % 10 = 0) m ON a.c_custkey = m.k LEFT JOIN (SELECT c_custkey AS bk, c_name FROM customer) b ON m.target = b.bk")
def t20(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    moved = c.filter("c_custkey % 10 = 0").select("c_custkey", (F.col("c_custkey") + 1).alias("target"))
    return c.join(moved, "c_custkey", "left").join(c.select(F.col("c_custkey").alias("target"), F.col("c_name").alias("new")), "target", "left").select("c_custkey", F.coalesce("new", "c_name").alias("resolved"))


@query("t22_record_commitment", "SELECT conv_id, sha256(string_agg(sha256(role || chr(0) || text), chr(10) ORDER BY turn)) AS commitment FROM conversations GROUP BY 1")
def t22(spark, d):
    row = F.struct("turn", F.sha2(F.concat_ws("\0", "role", "text"), 256).alias("h"))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("l")).select("conv_id", F.sha2(F.array_join(F.transform("l", lambda x: x["h"]), "\n"), 256).alias("commitment"))


@query("t24_codebook_errors", "SELECT doc_id, array_to_string(list_filter([CASE WHEN toxic = 1 AND quality = 1 THEN 'toxic_but_good' END, CASE WHEN quality = 0 AND toxic = 0 THEN 'bad_without_reason' END], lambda x: x IS NOT NULL), ',') AS errors FROM labels")
def t24(spark, d):
    rules = {"toxic_but_good": (F.col("toxic") == 1) & (F.col("quality") == 1), "bad_without_reason": (F.col("quality") == 0) & (F.col("toxic") == 0)}
    return table(spark, d, "labels").select("doc_id", F.array_join(T.codebook_errors(rules), ",").alias("errors"))


def vectors(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("v"), "label")


@query("v1_norms", "SELECT vec_id, round(sqrt(list_sum([x::DOUBLE * x::DOUBLE FOR x IN embedding])), 6) AS norm, len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0 AS finite FROM embeddings")
def v1(spark, d):
    return vectors(spark, d).select("vec_id", F.round(V.norm(F.col("v")), 6).alias("norm"), V.all_finite(F.col("v")).alias("finite"))


_COS = "s AS (SELECT q.vec_id AS query_id, d.vec_id, q.label AS own, d.label, list_dot_product(q.embedding::DOUBLE[], d.embedding::DOUBLE[]) / sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]) * list_dot_product(d.embedding::DOUBLE[], d.embedding::DOUBLE[])) AS c FROM embeddings q JOIN embeddings d ON q.vec_id % 100 = 0 AND q.vec_id <> d.vec_id), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(c, 9) DESC, vec_id)::INT AS rank FROM s)"


def neighbours(spark, d, k):
    v = vectors(spark, d)
    return V.cosine_neighbours(v, v.filter("vec_id % 100 = 0"), k)


@query("v3_cosine_neighbours", f"WITH {_COS} SELECT query_id, rank, vec_id, round(c, 6) AS cosine, label FROM k WHERE rank <= 15")
def v3(spark, d):
    return neighbours(spark, d, 15).withColumn("cosine", F.round("cosine", 6))


@query("v5_purity", f"WITH {_COS}, p AS (SELECT label, count(*) / sum(count(*)) OVER () AS p FROM embeddings GROUP BY 1) SELECT round(avg((label = own)::INT), 9) AS purity, count(DISTINCT query_id) AS queries, (SELECT round(sum(p * p), 9) FROM p) AS baseline FROM k WHERE rank <= 15")
def v5(spark, d):
    return V.purity(neighbours(spark, d, 15), vectors(spark, d))


@query("v4_preservation")
def v4(spark, d):
    """How many of the fifteen neighbours stay in the layout of ten leading axes."""
    v = vectors(spark, d)
    flat = V.projected(v, "v", V.principal_axes(v, "v", 10)).select("vec_id", F.array(*[f"pc{i}" for i in range(1, 11)]).alias("v"), "label")
    return V.preservation(neighbours(spark, d, 15), V.cosine_neighbours(flat, flat.filter("vec_id % 100 = 0"), 15), 15)


@query("v6_near_duplicates", f"WITH {_COS} SELECT query_id, vec_id, round(c, 6) AS cosine FROM k WHERE rank <= 50 AND c >= 0.45")
def v6(spark, d):
    return neighbours(spark, d, 50).filter("cosine >= 0.45").select("query_id", "vec_id", F.round("cosine", 6).alias("cosine"))


@query("v6_near_duplicate_links", "SELECT q.vec_id, sum((q.vec_id <> d.vec_id AND list_dot_product(q.embedding::DOUBLE[], d.embedding::DOUBLE[]) / sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]) * list_dot_product(d.embedding::DOUBLE[], d.embedding::DOUBLE[])) >= 0.45)::INT)::BIGINT AS links FROM embeddings q CROSS JOIN embeddings d GROUP BY 1")
def v6_links(spark, d):
    """Of every vector, without a rank that cuts: v6_near_duplicates tells of the 50 nearest of some, as its SQL does."""
    return V.near_links(vectors(spark, d), 0.45)


@query("v2_linear_layout")
def v2(spark, d):
    """Two leading axes: a linear layout in place of a nonlinear one."""
    v = vectors(spark, d)
    return V.projected(v, "v", V.principal_axes(v, "v", 2)).select("vec_id", F.round("pc1", 6).alias("pc1"), F.round("pc2", 6).alias("pc2"), "label")


@query("v9_wedges", "WITH w AS (SELECT s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS i, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier), p AS (SELECT s_suppkey, unnest(range(0, 9)) AS k, 2 * pi() * i / n AS a, 2 * pi() * (i + 1) / n AS b FROM w) SELECT s_suppkey, 0 AS corner, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y FROM supplier UNION ALL SELECT s_suppkey, (k + 1)::INT, round(cos(a + (b - a) * k / 8), 6) + 0.0, round(sin(a + (b - a) * k / 8), 6) + 0.0 FROM p")
def v9(spark, d):
    from math import pi

    from pyspark.sql import Window

    w = Window.partitionBy("s_nationkey")
    i, n = F.row_number().over(w.orderBy("s_suppkey")) - 1, F.count("*").over(w)
    df = table(spark, d, "supplier").select("s_suppkey", (2 * pi * i / n).alias("a"), (2 * pi * (i + 1) / n).alias("b"))
    out = df.select("s_suppkey", F.posexplode(V.wedge(F.col("a"), F.col("b"), F.lit(1.0))).alias("corner", "p"))
    return out.select("s_suppkey", "corner", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))
