"""Views over the driver's tables in SQL that both engines accept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: A line item is a citation; an order is a brief.
CITATIONS = """
SELECT l_orderkey AS brief_id,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS seq,
  CASE l_partkey % 4 WHEN 0 THEN 'full_case' WHEN 1 THEN 'short_case' WHEN 2 THEN 'id' ELSE 'supra' END AS cite_type,
  CASE WHEN l_partkey % 4 < 2 THEN CAST(l_suppkey % 2 AS STRING) END AS volume,
  CASE WHEN l_partkey % 4 < 2 THEN CASE l_linenumber % 3 WHEN 0 THEN 'S.W.3d' WHEN 1 THEN 'F.2d' ELSE 'U.S.' END END AS reporter,
  CASE WHEN l_partkey % 4 < 2 THEN CAST(l_partkey % 900 AS STRING) END AS page,
  CASE WHEN l_quantity > 25 THEN CAST(l_partkey % 900 + l_linenumber AS STRING) END AS pin_cite
FROM {lineitem}"""

#: Two thirds of the full citations' keys have a record.
RECORDS = """
SELECT volume, reporter, page, concat('case ', volume, ' ', reporter, ' ', page) AS record, CAST(page AS INT) AS start_page
FROM ({citations}) WHERE cite_type = 'full_case' AND CAST(page AS INT) % 3 <> 0 GROUP BY volume, reporter, page"""

BLOCKS = """
SELECT l_orderkey AS brief_id, CAST(1 + (seq - 1 - (seq - 1) % 3) / 3 AS INT) AS page_num, CAST(seq AS INT) AS block_no,
  72 + CASE l_suppkey % 3 WHEN 0 THEN 0.0 WHEN 1 THEN 20.0 ELSE 36.0 END AS x0, CAST(seq AS DOUBLE) AS y0,
  concat('block ', CAST(l_partkey AS STRING), ' of a text that is long enough to be counted') AS text, 0 AS block_type
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS seq FROM {lineitem})"""


def in_spark(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A view as a DataFrame. `{citations}` and the like nest."""
    for name, view in (("citations", CITATIONS), ("blocks", BLOCKS), ("records", RECORDS)):
        sql = sql.replace(f"({{{name}}})", f"({view})")
    sql = sql.replace("({citations})", f"({CITATIONS})")
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in sql}
    return spark.sql(sql, **used)


def in_duckdb(sql: str) -> str:
    for name, view in (("records", RECORDS), ("blocks", BLOCKS), ("citations", CITATIONS)):
        sql = sql.replace(f"({{{name}}})", f"({view})")
    for t in TABLES:
        sql = sql.replace(f"{{{t}}}", t)
    return sql
