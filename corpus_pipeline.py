"""A training corpus from raw documents: each stage's rows are written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.llm.jaccard_join import similar_components
from ledgerloom.llm.language_id import fit, held_out, identify
from ledgerloom.llm.mixing import mixed_documents
from ledgerloom.llm.queries import vocabulary
from ledgerloom.llm.sentencepiece_codec import piece_encode
from ledgerloom.llm.shared import saved, table
from ledgerloom.llm.suffix_dedup import remove_repeats


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected go: texts without a letter, or in no language that is learned."""
    model = fit(docs.filter(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    return identify(docs, model).filter("not rejected").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of 0.8 or more over five-word shingles join, the smallest doc_id stays, once.
    Documents without a word or an id link with nothing and stay."""
    found = similar_components(docs, words=5, percent=80)
    # Ids to drop are fewer than ids to keep.
    gone = found.groupBy("doc_id").agg(F.min("component_id").alias("component_id"), F.count("*").alias("rows"))
    again = gone.filter("doc_id is not null and rows > 1").limit(1).count()
    kept = docs.join(gone.filter("component_id < doc_id").select("doc_id").hint("shuffle_hash"), "doc_id", "left_anti")
    if again:
        kept = kept.filter("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(kept.filter("doc_id is null"))
    return kept.select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose every passage of 100 bytes or more that also stands earlier; those of which nothing but white
    space remains go."""
    cut = remove_repeats(docs, length=100)
    cut = cut.filter("n_removed = 0 or length(trim(whole)) > 0").withColumn("text", F.when(F.col("n_removed") > 0, F.col("whole")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return cut.select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources weigh 3, 1, 2 in turn and share one and a half times all words, none more than twice its own."""
    return mixed_documents(docs, [3, 1, 2], share=1.5, max_epochs=2.0)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row's whole text."""
    return piece_encode(docs, vocabulary("piece_bpe_32k.model")).select("doc_id", "lang", "source", "n_chars", "ids", "n_tokens", "parity")


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("source_mix", source_mix), ("token_ids", token_ids)]

#: No SQL: language, near-duplicate components over hashed prefixes and tokenization aren't expressible in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
