"""Sections of briefs: pages, headings, ranges and slices.

Tables: blocks(brief_id, page_num, block_no, x0, y0, x1, y1, text, block_type),
pages(brief_id, page_num, text). Page numbers are 1-based.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.functions.constants import CASES_PART
from docketry.functions.text import alternatives


def ordered_join(values: str, order: Sequence[str], separator: str) -> F.Column:
    """Aggregate: values in order, joined."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, values))), lambda s: s[values]), separator)


def pages_of(blocks: DataFrame, separator: str = "\n") -> DataFrame:
    """Text of each page: its text blocks in order."""
    text = blocks.where("block_type = 0").select("brief_id", "page_num", "block_no", "text")
    return text.groupBy("brief_id", "page_num").agg(ordered_join("text", ["block_no"], separator).alias("text"))


def documents_of(pages: DataFrame, separator: str = "\n") -> DataFrame:
    """Text of each brief: its pages in order."""
    return pages.groupBy("brief_id").agg(ordered_join("text", ["page_num"], separator).alias("text"))


def heading_pattern(heading: str, prefix: bool = False) -> str:
    """A line that is the heading, or (prefix) begins with it; any case."""
    words = alternatives([heading])
    return rf"(?im)^\s*{words}\b[^\n]*$" if prefix else rf"(?im)^\s*{words}\s*$"


def escaped(text: F.Column) -> F.Column:
    """A text as a pattern for itself."""
    return F.regexp_replace(text, r"([.\\\\+*?\[\]^$(){}|])", r"\\$1")


def heading_line(heading: F.Column, prefix: F.Column | None = None) -> F.Column:
    """heading_pattern of a column, for the functions that take a pattern in a column; null
    without a heading. Lines end with new lines alone."""
    words = escaped(heading)
    alone, begins = F.concat(F.lit(r"(?imd)^\s*"), words, F.lit(r"\s*$")), F.concat(F.lit(r"(?imd)^\s*"), words, F.lit(r"\b[^\n]*$"))
    return alone if prefix is None else F.when(F.coalesce(prefix, F.lit(False)), begins).otherwise(alone)


def find_sections(pages: DataFrame, start: str, ends: Sequence[str], prefix: bool = False) -> DataFrame:
    """brief_id, start_page, end_page, end_heading of the section under a heading.

    It starts on the first page with the heading. It ends on the first page from there on
    that has the first of `ends`, in list order, that occurs at all; else on the last page.
    """
    return first_section(pages, [(start, ends, prefix)]).select("brief_id", "start_page", "end_page", "end_heading")


def first_section(pages: DataFrame, choices: Sequence[tuple[str, Sequence[str], bool]]) -> DataFrame:
    """The first of several headings that a brief has: (start, ends, prefix) in order of choice.
    As find_sections, with choice, heading, prefix and ends. One aggregate by brief_id finds
    the pages of all headings."""
    text, page = F.col("text"), F.col("page_num")
    all_ends = list(dict.fromkeys(e for _, ends, _ in choices for e in ends))
    first = [F.min(F.when(text.rlike(heading_pattern(start, prefix)), page)).alias(f"start_{i}") for i, (start, _, prefix) in enumerate(choices)]
    marks = [F.collect_set(F.when(text.rlike(heading_pattern(e)), page)).alias(f"end_{j}") for j, e in enumerate(all_ends)]
    by_brief = pages.groupBy("brief_id").agg(F.max(page).alias("last"), *first, *marks)
    found = []
    for i, (heading, ends, prefix) in enumerate(choices):
        start = F.col(f"start_{i}")
        later = [F.array_min(F.filter(f"end_{all_ends.index(e)}", lambda p, start=start: p >= start)) for e in ends]
        mark = F.coalesce(*[F.when(p.isNotNull(), F.struct(p.alias("page"), F.lit(e).alias("heading"))) for p, e in zip(later, ends, strict=True)], F.lit(None).cast("struct<page: int, heading: string>"))
        section = F.struct(
            start.alias("start_page"), F.coalesce(mark["page"], F.col("last")).alias("end_page"), mark["heading"].alias("end_heading"),
            F.lit(i).alias("choice"), F.lit(heading).alias("heading"), F.lit(prefix).alias("prefix"), F.array(*map(F.lit, ends)).cast("array<string>").alias("ends"),
        )
        found.append(F.when(start.isNotNull(), section))
    return by_brief.select("brief_id", F.coalesce(*found).alias("s")).where("s IS NOT NULL").select("brief_id", "s.*")


ARGUMENT_ENDS = ("Prayer", "Conclusion", "Certificate of Compliance", "Certificate of Service")
ARGUMENT = (("Reply Argument", ARGUMENT_ENDS, False), ("Argument", ARGUMENT_ENDS, False), ("Arguments", ARGUMENT_ENDS, False), ("Argument", ARGUMENT_ENDS, True))
AUTHORITIES = (("Index of Authorities", ("Statement of the Case", "Argument"), False), ("Table of Authorities", ("Statement of the Case", "Argument"), False))


def section_text(pages: DataFrame, sections: DataFrame, separator: str = "\n") -> DataFrame:
    """Text of the section's pages. The first page is cut after the first line that is the
    section's heading (or begins with it, where the section was found by prefix), the last
    one before the first line that is the end heading; other lines stay, whatever they
    begin with."""
    prefix = F.col("prefix") if "prefix" in sections.columns else F.lit(False)
    own = sections.select("brief_id", "heading", "end_heading", "start_page", "end_page", prefix.alias("_prefix"))
    own = pages.join(own, "brief_id").where(F.col("page_num").between(F.col("start_page"), F.col("end_page")))
    after = F.split("text", heading_line(F.col("heading"), F.col("_prefix")), 2)
    text = F.when(F.col("page_num") == F.col("start_page"), F.element_at(after, -1)).otherwise(F.col("text"))
    own = own.withColumn("text", text)
    before = F.split("text", heading_line(F.col("end_heading")), 2)
    text = F.when((F.col("page_num") == F.col("end_page")) & F.col("end_heading").isNotNull(), before[0]).otherwise(F.col("text"))
    whole = own.withColumn("text", text).groupBy("brief_id").agg(ordered_join("text", ["page_num"], separator).alias("text"))
    return whole.select("brief_id", F.trim("text").alias("text"))


def cases_part(text: F.Column) -> F.Column:
    """The list of cases in a table of authorities."""
    return F.regexp_extract(text, CASES_PART, 1)


def phrase_position(blocks: DataFrame, phrases: DataFrame, head: int | None = 50) -> DataFrame:
    """y0 of the first block, by page and number, that holds a phrase (its first `head`
    characters; None: all). phrases: brief_id, phrase_id, phrase."""
    wanted = F.col("phrase") if head is None else F.left("phrase", F.lit(head))
    met = blocks.join(phrases, "brief_id").where(F.contains(F.lower("text"), F.lower(wanted)))
    return met.groupBy("brief_id", "phrase_id").agg(F.min_by(F.struct("page_num", "y0"), F.struct("page_num", "block_no")).alias("at")).select("brief_id", "phrase_id", "at.page_num", "at.y0")
