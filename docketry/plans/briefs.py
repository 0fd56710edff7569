"""Whole pipelines over many briefs: parse, extract items, validate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions import names
from docketry.functions import text as T
from docketry.functions.citations import citations, that_parenthetical
from docketry.operators import layout, propose, report, resolve, sections, verify


@dataclass(frozen=True)
class Parsed:
    sections: DataFrame
    units: DataFrame
    citations: DataFrame
    propositions: DataFrame
    status: DataFrame


def heading_positions(blocks: DataFrame, found: DataFrame) -> DataFrame:
    """brief_id, start_y of the section's heading on its first page, and end_marks: for each
    page of the section with one of its end headings, the first one's y0. A heading is a line
    of its own; one found by prefix may go on."""
    ends = F.concat(F.lit(r"(?imd)^\s*(?:"), F.array_join(F.transform("ends", sections.escaped), "|"), F.lit(r")\s*$"))
    own = found.select("brief_id", "start_page", F.col("end_page").alias("_last"), sections.heading_line(F.col("heading"), F.col("prefix")).alias("_start"), F.when(F.size("ends") > 0, ends).alias("_end"))
    own = blocks.where("block_type = 0").join(own, "brief_id").where("page_num BETWEEN start_page AND _last")
    start = F.when((F.col("page_num") == F.col("start_page")) & F.regexp(F.col("text"), F.col("_start")), F.col("y0"))
    by_page = own.groupBy("brief_id", "page_num").agg(F.min(start).alias("start_y"), F.min(F.when(F.regexp(F.col("text"), F.col("_end")), F.col("y0"))).alias("end_y"))
    marks = F.collect_list(F.when(F.col("end_y").isNotNull(), F.struct(F.col("page_num").alias("page"), F.col("end_y").alias("y"))))
    return by_page.groupBy("brief_id").agg(F.min("start_y").alias("start_y"), marks.alias("end_marks"))


def units_of(paragraphs: DataFrame) -> DataFrame:
    """Sentences of body paragraphs and whole block quotations, numbered through the brief."""
    parts = F.when(F.col("kind") == "block_quote", F.array("text")).otherwise(T.sentences(F.col("text")))
    rows = paragraphs.select("brief_id", "para_idx", "kind", F.posexplode(parts).alias("sent_idx", "text"))
    number = F.row_number().over(Window.partitionBy("brief_id").orderBy("para_idx", "sent_idx")) - 1
    return rows.withColumn("text", T.recogniser_text(F.col("text"))).withColumn("unit_seq", number)


def recognised(units: DataFrame) -> DataFrame:
    """One row for each citation of each unit, numbered through the brief."""
    rows = units.select("brief_id", "unit_seq", F.col("text").alias("_text"), F.posexplode(citations(F.col("text"))).alias("cite_seq", "c")).select("brief_id", "unit_seq", "cite_seq", "_text", "c.*")
    rows = rows.withColumns({"signal": T.signal_before(F.left("_text", F.col("start"))), "case_name": names.party_name(F.col("plaintiff"), F.col("defendant"))})
    number = F.row_number().over(Window.partitionBy("brief_id").orderBy("unit_seq", "cite_seq"))
    return rows.withColumn("seq", number).drop("_text")


def parse(blocks: DataFrame, records: DataFrame) -> Parsed:
    """The argument of every brief. records: volume, reporter, page, record (struct with
    case_name), start_page. A brief without the section has status no_section."""
    pages = sections.pages_of(blocks)
    found = sections.first_section(pages, sections.ARGUMENT)
    margin = layout.margins(blocks.join(found.select("brief_id", "start_page", "end_page"), "brief_id").where("page_num BETWEEN start_page AND end_page"))
    body = layout.body_blocks(blocks, margin, found, heading_positions(blocks, found))
    units = propose.attach_intros(units_of(layout.paragraphs(body)))
    cites = resolve.resolve(recognised(units), records)
    cites = cites.withColumn("case_name", F.coalesce("record.case_name", "case_name"))
    made = propose.propositions(units, cites)
    status = blocks.select("brief_id").distinct().join(found.select("brief_id", F.lit("ok").alias("status")), "brief_id", "left").fillna("no_section", ["status"])
    return Parsed(found, units, cites, made, status)


def items(pages: DataFrame, choices=sections.ARGUMENT) -> DataFrame:
    """Citations with the text before them: one row for each citation of a section's text,
    with signal, parenthetical, quotations, content type and string-citation group."""
    found = sections.first_section(pages, choices)
    whole = sections.section_text(pages, found).withColumn("text", T.recogniser_text(F.col("text"), dashes=False))
    rows = whole.withColumn("_starts", T.boundaries(F.col("text"))).select("brief_id", "text", "_starts", F.posexplode(citations(F.col("text"))).alias("seq", "c"))
    rows = rows.select("brief_id", "text", "_starts", (F.col("seq") + 1).alias("seq"), "c.start", "c.end", "c.paren_end", "c.cite_type", F.col("c.text").alias("cite_text"))
    two_back = T.unit_start_in(F.col("_starts"), F.col("text"), F.col("start"))
    rows = resolve.preceding_start(rows.withColumn("sentence_start", two_back))
    between = F.substring("text", F.col("actual_start") + 1, F.greatest(F.col("start") - F.col("actual_start"), F.lit(0)))
    before = T.without_annotation(F.regexp_replace(T.strip(between), r"^[.,;:!?\s]+", ""))
    rows = rows.withColumn("_before", before).withColumns({"signal": T.signal_at_end(F.col("_before")), "parenthetical": that_parenthetical(F.col("text"), F.col("end"))})
    rows = rows.withColumn("proposition", T.without_signal(F.col("_before"))).withColumn("is_string_cite", T.is_string_cite(F.col("proposition")))
    rows = resolve.string_groups(rows)
    quoted = T.quoted_spans(F.col("proposition"))
    return rows.select(
        "brief_id", "seq", F.col("proposition").alias("preceding_text"), F.col("cite_text").alias("text"), "cite_type", "start", "end", "signal", "parenthetical",
        T.needs_review(F.col("signal"), F.col("parenthetical")).alias("needs_review"), (F.size(quoted) > 0).alias("has_quotation"), quoted.alias("quotations"),
        T.content_type(F.coalesce("proposition", F.lit("")), F.lit(False)).alias("content_type"), "is_string_cite", "string_cite_group",
    )


def validate(parsed: Parsed, cases: DataFrame, html: DataFrame, base: str = "cases") -> DataFrame:
    """Verdicts on all propositions. cases: path, text; html: path, page, text."""
    local = F.transform("citations", lambda c: F.struct(c["text"].alias("text"), c["pin_cite"].alias("pin_cite"), names.case_path(base, c["volume"], c["reporter"], c["page"], "json").alias("local_json_path")))
    return verify.validate(parsed.propositions.withColumn("citations", local), cases, html)


def report_of(validations: DataFrame) -> DataFrame:
    return report.html_report(validations)
