"""Layout: margins, headers, paragraphs and block quotations from blocks.

Every window is partitioned by brief_id and ordered by (page_num, block_no), so the plan
has one exchange on brief_id for all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions.text import join_hyphens, join_line_hyphens, strip
from docketry.operators.sections import ordered_join

ORDER = ("page_num", "block_no")


def margins(blocks: DataFrame, single_indent: float = 36.0, least_length: int = 30) -> DataFrame:
    """brief_id, body_margin, para_indent: the two most frequent left edges of long text
    blocks (first seen first among equals); the lesser is the body. One edge alone implies
    an indent of `single_indent` more."""
    long = blocks.where((F.col("block_type") == 0) & (F.length(strip(F.col("text"))) > least_length))
    edges = long.groupBy("brief_id", F.bround("x0").alias("edge")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*ORDER)).alias("first"))
    top = Window.partitionBy("brief_id").orderBy(F.desc("n"), "first")
    two = edges.withColumn("_n", F.row_number().over(top)).where("_n <= 2")
    both = two.groupBy("brief_id").agg(F.min("edge").alias("body_margin"), F.max("edge").alias("other"), F.count(F.lit(1)).alias("n"))
    return both.select("brief_id", "body_margin", F.when(F.col("n") == 1, F.col("body_margin") + single_indent).otherwise(F.col("other")).alias("para_indent"))


def body_blocks(blocks: DataFrame, margin: DataFrame, sections: DataFrame, headings: DataFrame | None = None, far: float = 100.0) -> DataFrame:
    """Text blocks of the section, without headers, footers and what lies outside the
    headings. headings: brief_id, start_y (on the first page), end_marks (page, y: where a
    page ends, on any page)."""
    own = blocks.join(sections.select("brief_id", "start_page", "end_page"), "brief_id").join(margin, "brief_id", "left")
    own = own.where((F.col("block_type") == 0) & F.col("page_num").between(F.col("start_page"), F.col("end_page")))
    own = own.where(F.col("body_margin").isNull() | (F.abs(F.col("x0") - F.col("body_margin")) <= far))
    if headings is None:
        return own
    own = own.join(headings.select("brief_id", "start_y", "end_marks"), "brief_id", "left")
    after = F.coalesce((F.col("page_num") > F.col("start_page")) | (F.col("y0") > F.col("start_y")), F.lit(True))
    beyond = F.exists("end_marks", lambda m: (m["page"] == F.col("page_num")) & (F.col("y0") >= m["y"]))
    return own.where(after & ~F.coalesce(beyond, F.lit(False))).drop("start_y", "end_marks")


def quote_runs(blocks: DataFrame, near: float = 3.0, least: int = 2) -> DataFrame:
    """Block quotations: runs of `least` or more consecutive blocks beyond the body margin.

    Returns brief_id, run, blocks, start_page, end_page, text. Gaps and islands: within
    indented blocks, position minus rank among them is constant along a run.
    """
    order = Window.partitionBy("brief_id").orderBy(*ORDER)
    flagged = blocks.withColumn("_hot", F.col("x0") > F.col("body_margin") + near).withColumn("_n", F.row_number().over(order))
    hot = flagged.where("_hot").withColumn("run", F.col("_n") - F.row_number().over(order))
    runs = hot.groupBy("brief_id", "run").agg(F.count(F.lit(1)).alias("blocks"), F.min("page_num").alias("start_page"), F.max("page_num").alias("end_page"), ordered_join("text", ORDER, " ").alias("text"))
    return runs.where(F.col("blocks") >= least).withColumn("text", join_line_hyphens(F.col("text")))


def paragraph_ids(blocks: DataFrame, quote: float = 25.0, indent: float = 10.0) -> DataFrame:
    """Adds para_idx (0-based) and kind (body or block_quote) to blocks with body_margin.

    Two or more consecutive blocks indented over `quote` are a block quotation. A lone one
    opens a new body paragraph only if the next block outside (indent, quote] is indented
    over `quote` as well.
    """
    order = Window.partitionBy("brief_id").orderBy(*ORDER)
    ahead = order.rowsBetween(1, Window.unboundedFollowing)
    own = blocks.withColumn("_indent", F.coalesce(F.col("x0") - F.col("body_margin"), F.lit(0.0)))
    own = own.withColumn("_hot", F.col("_indent") > quote)
    alike = F.coalesce(F.lag("_hot").over(order) & F.col("_hot"), F.lit(False)) | F.coalesce(F.lead("_hot").over(order) & F.col("_hot"), F.lit(False))
    clear = F.when(~((F.col("_indent") > indent) & (F.col("_indent") <= quote)), F.col("_hot"))
    own = own.withColumns({"_quote": alike, "_next": F.coalesce(F.first(clear, True).over(ahead), F.lit(False))})
    before = F.lag("_quote").over(order)
    opens = before.isNull() | (F.col("_quote") != before) | (F.col("_hot") & ~F.col("_quote") & F.col("_next"))
    own = own.withColumn("_opens", opens)
    number = F.sum(F.col("_opens").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1
    return own.select(*blocks.columns, number.cast("int").alias("para_idx"), F.when(F.col("_quote"), "block_quote").otherwise("body").alias("kind"))


def paragraphs(blocks: DataFrame) -> DataFrame:
    """brief_id, para_idx, kind, start_page, text: cleaned text of each paragraph."""
    made = paragraph_ids(blocks).groupBy("brief_id", "para_idx", "kind").agg(F.min("page_num").alias("start_page"), ordered_join("text", ORDER, " ").alias("text"))
    return made.withColumn("text", join_hyphens(F.col("text")))
