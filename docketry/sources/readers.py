"""Readers and writers: briefs, cases, parsed results, registries.

Decoders of page layout are plug-ins: any function from a file's bytes to rows of BLOCKS.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCKS = "brief_id string, page_num int, block_no int, x0 double, y0 double, x1 double, y1 double, text string, block_type int"
WORDS = "brief_id string, page_num int, x0 double, y0 double, x1 double, y1 double, word string, block_no int, line_no int, word_no int"
CASE = (
    "id bigint, name string, name_abbreviation string, decision_date string, docket_number string, first_page string, last_page string, "
    "citations array<struct<type: string, cite: string>>, court struct<name: string, name_abbreviation: string>, "
    "casebody struct<judges: string, parties: string, opinions: array<struct<type: string, text: string, author: string>>, attorneys: string>, "
    "source string, cluster_id bigint, absolute_url string"
)
CITATION = (
    "struct<text: string, case_name: string, volume: string, reporter: string, page: string, pin_cite: string, cite_type: string, span: array<int>, signal: string, "
    "parenthetical: string, refers_to: string, cl_record: struct<caseName: string, citation: array<string>, cluster_id: bigint>, local_json_path: string, local_html_path: string>"
)
PARSED = (
    f"argument struct<start_page: int, end_page: int, paragraphs: array<struct<type: string, intro: string, text: string, citations: array<{CITATION}>, sentences: array<struct<text: string, citations: array<{CITATION}>>>>>>, "
    f"summary struct<toa_cases: array<string>, toa_case_count: int, argument_cases: array<string>, argument_case_count: int, cases_match: boolean>, "
    f"propositions array<struct<text: string, type: string, intro: string, citations: array<{CITATION}>>>"
)


def binary_files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)


def decoded(files: DataFrame, decode: Callable[[bytes], Iterable[dict]]) -> DataFrame:
    """Blocks of each file; brief_id is the file's path. Files are decoded one at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                rows = [{"brief_id": path, **row} for row in decode(content)]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in BLOCKS.split(", ")])

    return files.select("path", "content").mapInPandas(run, BLOCKS)


def words_of(blocks: DataFrame) -> DataFrame:
    """Words of text blocks without positions of their own: each has its block's box."""
    split = F.posexplode(F.split(F.trim(F.regexp_replace("text", r"(?U)\s+", " ")), " ")).alias("word_no", "word")
    return blocks.where("block_type = 0").select("brief_id", "page_num", "x0", "y0", "x1", "y1", "block_no", F.lit(0).alias("line_no"), split).select(*[c.split()[0] for c in WORDS.split(", ")])


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CASE).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path).withColumn("path", F.regexp_replace(F.input_file_name(), "^file:/+", "/"))


def read_case_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.html").text(path).withColumn("path", F.regexp_replace(F.input_file_name(), "^file:/+", "/"))


def read_parsed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PARSED).option("multiLine", True).json(path).withColumn("path", F.regexp_replace(F.input_file_name(), "^file:/+", "/"))


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def existing_files(spark: SparkSession, path: str) -> DataFrame:
    """Paths below a folder; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")


def assemble_cases(records: DataFrame, opinions: DataFrame) -> DataFrame:
    """Case files from records and their opinions (cluster_id, seq, type, text, author, html)."""
    from docketry.functions.text import html_text

    body = F.coalesce(F.nullif("text", F.lit("")), html_text(F.col("html")))
    held = opinions.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("seq", "type", body.alias("text"), "author"))).alias("_all"))
    made = records.join(held, "cluster_id", "left")
    listed = F.transform("_all", lambda o: F.struct(o["type"].alias("type"), o["text"].alias("text"), o["author"].alias("author")))
    return made.withColumn("casebody", F.struct(listed.alias("opinions"))).drop("_all")


def latest(rows: DataFrame, key: str, version: str) -> DataFrame:
    """Current rows of an append-only table: updates append, and a row whose `deleted` is true removes."""
    last = Window.partitionBy(key).orderBy(F.desc(version))
    return rows.withColumn("_n", F.row_number().over(last)).where("_n = 1 AND NOT coalesce(deleted, false)").drop("_n")


def registry_tables(spark: SparkSession, database: str) -> None:
    """Create the registry's tables where they are missing."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.users (user_id INT, email STRING, is_verified BOOLEAN, created_at TIMESTAMP_NTZ, version BIGINT, deleted BOOLEAN) USING parquet")
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {database}.briefs (brief_id INT, user_id INT, filename STRING, uploaded_at TIMESTAMP_NTZ, processed_at TIMESTAMP_NTZ, argument_data STRING, "
        "original_pdf_path STRING, annotated_pdf_path STRING, argument_start_page INT, argument_end_page INT, total_statements INT, total_quotations INT, total_citations INT, version BIGINT, deleted BOOLEAN) USING parquet"
    )


def read_jdbc(spark: SparkSession, url: str, table: str, properties: dict[str, str], column: str | None = None, bounds: tuple[int, int] = (0, 0), parts: int = 1) -> DataFrame:
    """A database table; with a numeric column, in parallel parts."""
    if column is None:
        return spark.read.jdbc(url, table, properties=properties)
    return spark.read.jdbc(url, table, column=column, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts, properties=properties)


def write_jdbc(rows: DataFrame, url: str, table: str, properties: dict[str, str]) -> None:
    rows.write.mode("append").jdbc(url, table, properties=properties)


def write_cases(cases: DataFrame, path: str) -> None:
    """Case files as JSON, in folders by reporter and volume. Needs reporter, volume."""
    from docketry.functions.names import reporter_slug

    cases.withColumn("slug", reporter_slug(F.col("reporter"))).where("slug IS NOT NULL").write.mode("append").partitionBy("slug", "volume").json(path)


def write_reports(reports: DataFrame, path: str) -> None:
    """One HTML text for each brief, in folders by brief. Needs brief_id, html."""
    reports.select("brief_id", F.col("html").alias("value")).write.mode("overwrite").partitionBy("brief_id").text(path)
