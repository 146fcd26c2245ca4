"""Loads the engine's three-level catalog (item, edition, link) and its side tables.

``Catalog.from_tables`` maps a star schema onto it: customers are items, orders their editions, line items the links,
suppliers the link checks. Only the columns that a query needs reach the scan, since every table is a lazy projection.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PRIMARY = "R"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@dataclass(frozen=True)
class Catalog:
    items: DataFrame
    editions: DataFrame
    links: DataFrame
    checks: DataFrame

    @classmethod
    def from_tables(cls, spark: SparkSession, sf_dir: str) -> Catalog:
        orders = table(spark, sf_dir, "orders")
        years = orders.groupBy("o_custkey").agg(F.min(F.year("o_orderdate")).alias("year"))
        items = table(spark, sf_dir, "customer").join(years, F.col("c_custkey") == F.col("o_custkey"), "left").select(
            F.col("c_custkey").alias("item_id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("kind"),
            F.col("c_acctbal").alias("rating"), F.col("c_nationkey").alias("genre"), "year",
        )
        editions = orders.select(
            F.col("o_orderkey").alias("edition_id"), F.col("o_custkey").alias("item_id"), F.col("o_orderpriority").alias("quality"),
            F.col("o_orderstatus").alias("hdr"), F.col("o_totalprice").alias("size"), F.col("o_orderdate").alias("created"),
        )
        links = table(spark, sf_dir, "lineitem").select(
            F.col("l_orderkey").alias("edition_id"), F.col("l_returnflag").alias("provider"), F.col("l_suppkey").alias("url_key"),
            (F.col("l_linestatus") == "F").alias("deleted"), F.col("l_shipdate").alias("created"), F.col("l_linenumber").alias("line"),
            F.col("l_partkey").alias("part_key"), F.col("l_extendedprice").alias("price"),
        )
        bal = F.col("s_acctbal")
        status = F.when(bal < 0, "invalid").when(bal < 2000, "unknown").when(bal < 4000, "queued").otherwise("valid")
        checks = table(spark, sf_dir, "supplier").select(
            F.explode(F.array(*map(F.lit, "ANR"))).alias("provider"), F.col("s_suppkey").alias("url_key"), status.alias("status"), bal.alias("priority_score"),
        ).where("status <> 'valid' or provider <> 'A'")
        return cls(items, editions, links, checks)


SQL = """WITH items AS (
  SELECT c_custkey AS item_id, c_name AS title, c_mktsegment AS kind, c_acctbal AS rating, c_nationkey AS genre, y.year
  FROM customer LEFT JOIN (SELECT o_custkey, CAST(min(year(o_orderdate)) AS INT) AS year FROM orders GROUP BY 1) y ON o_custkey = c_custkey),
editions AS (
  SELECT o_orderkey AS edition_id, o_custkey AS item_id, o_orderpriority AS quality, o_orderstatus AS hdr, o_totalprice AS size, o_orderdate AS created
  FROM orders),
links AS (
  SELECT l_orderkey AS edition_id, l_returnflag AS provider, l_suppkey AS url_key, l_linestatus = 'F' AS deleted, l_shipdate AS created,
         l_linenumber AS line, l_partkey AS part_key, l_extendedprice AS price
  FROM lineitem),
checks AS (
  SELECT * FROM (
    SELECT unnest(['A', 'N', 'R']) AS provider, s_suppkey AS url_key,
           CASE WHEN s_acctbal < 0 THEN 'invalid' WHEN s_acctbal < 2000 THEN 'unknown' WHEN s_acctbal < 4000 THEN 'queued' ELSE 'valid' END AS status,
           s_acctbal AS priority_score
    FROM supplier) WHERE status <> 'valid' OR provider <> 'A'),
live AS (
  SELECT l.* FROM links l WHERE NOT deleted AND NOT EXISTS (
    SELECT 1 FROM checks c WHERE c.provider = l.provider AND c.url_key = l.url_key AND c.status = 'invalid'))
"""
