"""Exact duplicates by a tree of merges over sorted runs of digests; only DataFrame functions are used.

A run is what a block of neighbouring rows holds: its distinct digests in order, each with the best document and the
number of rows. Runs are numbered; in each round ``FAN_BITS`` bits of a run's number give way to the same bits of the
digest, so a run parts into 2**FAN_BITS and merges with the parts of as many others. After the last round the number
is the digest's own, and every digest stands once. Spark merges a run before it sends it (a partial aggregate over
sorted rows) and once more on arrival, so a text that a third of all rows share is at most one row a run in any round.
What was decided goes down the same tree to the rows. Digests count as equal only if a 64-bit hash, SHA-256 and the
length in bytes all agree; that is verified in every merge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.llm.shared import saved

#: Bits of a run's number that change in a round: runs that meet are 2 ** FAN_BITS at most.
FAN_BITS = 3
#: Neighbouring rows of an input partition that make up a run are 2 ** BLOCK_BITS.
BLOCK_BITS = 10
#: What must agree for two texts to be one. The first column decides about order and places in the tree.
IDENTITY = ["head", "digest", "n_bytes"]


def rounds(runs: int) -> list[int]:
    """Masks of the bits that change, a round each, for a power of two of runs."""
    bits = runs.bit_length() - 1
    return [((1 << min(FAN_BITS, bits - low)) - 1) << low for low in range(0, bits, FAN_BITS)]


def moved(mask: int) -> Column:
    return F.col("run").bitwiseAND(F.lit(~mask)).bitwiseOR(F.col("head").bitwiseAND(F.lit(mask)))


def merged(level: DataFrame, run: Column, best: Column, rows: Column) -> DataFrame:
    """One row for each run and digest. Structs as aggregates make Spark sort and merge instead of hashing."""
    return level.groupBy(run.alias("run"), *IDENTITY).agg(best.alias("best"), F.sum(rows).alias("rows"))


def marked(tagged: DataFrame, keep: str) -> DataFrame:
    """Groups of the rows of (doc_id, text, _tag), where tags are unique."""
    pick = {"largest": F.max, "smallest": F.min}[keep]
    # Rows without an id come last in either order.
    order = F.struct((F.col("doc_id").isNull() if keep == "smallest" else F.col("doc_id").isNotNull()).alias("null"), "doc_id", F.col("_tag").alias("tag"))
    text = F.coalesce(F.col("text"), F.lit(""))
    runs = 1 << max(1, int(tagged.sparkSession.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()
    block = F.pmod(F.xxhash64(F.shiftright("_tag", BLOCK_BITS)), F.lit(runs)).cast("long")
    rows = saved(tagged.select("doc_id", "_tag", block.alias("run"), F.xxhash64(text).alias("head"), F.unhex(F.sha2(text, 256)).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes")), "digests")
    levels = [saved(merged(rows, F.col("run"), pick(order), F.lit(1)), "digest-runs")]
    masks = rounds(runs)
    for i, mask in enumerate(masks):
        level = merged(levels[-1], moved(mask), pick("best"), F.col("rows"))
        levels.append(saved(level, "digest-runs") if i < len(masks) - 1 else level)
    # Only digests of more than one row need to go back.
    known = levels.pop().filter("rows > 1")
    for level, mask in zip(reversed(levels), reversed(masks), strict=True):
        below = level.select(F.col("run").alias("own"), moved(mask).alias("run"), *IDENTITY)
        known = below.join(known, ["run", *IDENTITY]).select(F.col("own").alias("run"), *IDENTITY, "best", "rows")
    out = rows.join(known, ["run", *IDENTITY], "left")
    alone = F.col("rows").isNull()
    return out.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"), F.coalesce("rows", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("best.tag") == F.col("_tag"))).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "_tag",
    )


def exact_duplicates(df: DataFrame, keep: str = "smallest") -> DataFrame:
    """One row for each row of df (doc_id, text): keep_id, the smallest or largest doc_id with the same text;
    group_size, rows with that text; kept, whether this is the row that stays; text_sha256.

    A null text reads as an empty one; texts of any length are judged whole. Rows that repeat an id and its text count
    as rows, and one of them stays. Rows without an id are judged too and stay only if no row of the group has one.
    Other columns of df, whatever their names, don't matter. An empty table gives no rows."""
    return marked(df.select("doc_id", "text", F.monotonically_increasing_id().alias("_tag")), keep).drop("_tag")


def distinct_documents(df: DataFrame, keep: str = "smallest") -> DataFrame:
    """The rows of df that stay, with all their columns. df is written once, as its rows must keep their tags."""
    rows = saved(df.withColumn("_tag", F.monotonically_increasing_id()), "tagged-documents")
    stay = marked(rows.select("doc_id", "text", "_tag"), keep).filter("kept").select("_tag")
    return rows.join(stay, "_tag", "left_semi").select(*df.columns)
