"""The analysis frame: one row for each line, with the roles that most queries use, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.functions.expressions import home_status
from ledgerloom.sources.tables import table

#: The customer region that stands for no region in particular, and the jurisdiction without a home region.
GENERAL = "MIDDLE EAST"


def analysis_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cluster, model (in jurisdiction), region_focus, lang, tier, domain, route, outcomes y and y2, original
    label y0 (missing for some), home_status, and the line's own keys and measures."""
    t = lambda name: table(spark, sf_dir, name)
    places = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    suppliers = t("supplier").join(places, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("model"), F.col("r_name").alias("jurisdiction"))
    focus = F.when(F.col("r_name") == GENERAL, "General").otherwise(F.col("r_name"))
    customers = t("customer").join(places, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", focus.alias("region_focus"), F.col("c_mktsegment").alias("domain"))
    orders = t("orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("o_custkey").alias("cluster"), "region_focus", "domain", F.col("o_orderstatus").alias("route"))
    lines = t("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", F.col("l_returnflag").alias("lang"), F.col("l_linestatus").alias("tier"),
        (F.col("l_discount") >= 0.09).cast("int").alias("y"), (F.col("l_quantity") > 45).cast("int").alias("y2"),
        F.when(F.col("l_suppkey") % 7 != 0, (F.col("l_tax") >= 0.06).cast("int")).alias("y0"),
    )
    df = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).drop("o_orderkey", "s_suppkey")
    return df.withColumn("home_status", home_status(F.col("region_focus"), F.col("jurisdiction"), "General", GENERAL))


FRAME_SQL = """
frame AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag AS lang, l_linestatus AS tier,
    (l_discount >= 0.09)::INT AS y, (l_quantity > 45)::INT AS y2, CASE WHEN l_suppkey % 7 <> 0 THEN (l_tax >= 0.06)::INT END AS y0,
    o_custkey AS cluster, c_mktsegment AS domain, o_orderstatus AS route, sn.n_name AS model, sr.r_name AS jurisdiction,
    CASE WHEN cr.r_name = 'MIDDLE EAST' THEN 'General' ELSE cr.r_name END AS region_focus,
    CASE WHEN cr.r_name = 'MIDDLE EAST' THEN 'general' WHEN sr.r_name = 'MIDDLE EAST' THEN 'not_defined' WHEN cr.r_name = sr.r_name THEN 'home' ELSE 'away' END AS home_status
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
    JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN region cr ON cn.n_regionkey = cr.r_regionkey
    JOIN nation sn ON s_nationkey = sn.n_nationkey JOIN region sr ON sn.n_regionkey = sr.r_regionkey)"""


def with_frame(sql: str) -> str:
    """SQL that starts from the frame; further common tables follow a leading comma."""
    return f"WITH {FRAME_SQL}{sql if sql.lstrip().startswith(',') else ' ' + sql}"
