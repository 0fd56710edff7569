"""Summaries, comparisons and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions import text as T
from docketry.functions.names import compared_name
from docketry.operators.sections import ordered_join

RESULTS = ("verified", "failed", "uncertain")


def counts_by(rows: DataFrame, key: str, column: str, values: tuple[str, ...]) -> DataFrame:
    """One row for each key with a count of each value and of all."""
    return rows.groupBy(key).agg(*[F.count_if(F.col(column) == v).alias(v) for v in values], F.count(F.lit(1)).alias("total"))


def validation_summary(validations: DataFrame) -> DataFrame:
    return counts_by(validations, "brief_id", "result", RESULTS)


def case_list(names: DataFrame, name: str = "case_name") -> DataFrame:
    """Distinct case names of each brief, sorted, and their number."""
    made = names.where(T.present(F.col(name)).isNotNull()).groupBy("brief_id").agg(F.array_sort(F.collect_set(name)).alias("cases"))
    return made.withColumn("case_count", F.size("cases"))


def compare_authorities(listed: DataFrame, argued: DataFrame, name: str = "case_name", unicode: bool = True) -> DataFrame:
    """brief_id, both case lists and counts, cases_match (as sets of compared names), and
    the plain differences both ways. A brief missing on one side has an empty list there."""
    side = lambda rows, argued: rows.select("brief_id", F.col(name).alias("_name"), F.lit(argued).alias("_argued"))
    rows = side(listed, False).unionByName(side(argued, True)).withColumn("_compared", compared_name(F.col("_name"), unicode))
    held = lambda column, argued: F.array_sort(F.collect_set(F.when(F.col("_argued") == argued, F.col(column))))
    both = rows.groupBy("brief_id").agg(held("_name", False).alias("toa_cases"), held("_name", True).alias("argument_cases"), held("_compared", False).alias("_toa"), held("_compared", True).alias("_argument"))
    return both.select(
        "brief_id", "toa_cases", "argument_cases",
        F.size("toa_cases").alias("toa_case_count"), F.size("argument_cases").alias("argument_case_count"),
        (F.col("_toa") == F.col("_argument")).alias("cases_match"),
        F.array_except("toa_cases", "argument_cases").alias("only_toa"), F.array_except("argument_cases", "toa_cases").alias("only_argument"),
    )


def totals(units: DataFrame, cites: DataFrame) -> DataFrame:
    """Paragraphs, sentences, block quotations and citations of each brief."""
    u = units.groupBy("brief_id").agg(
        F.count_distinct(F.when(F.col("kind") == "body", F.col("para_idx"))).alias("paragraphs"), F.count_if(F.col("kind") == "body").alias("sentences"), F.count_if(F.col("kind") == "block_quote").alias("block_quotes")
    )
    return u.join(cites.groupBy("brief_id").agg(F.count(F.lit(1)).alias("citations")), "brief_id", "left").fillna(0, ["citations"])


def _card(shown: int) -> Column:
    cites = F.array_join(F.transform(F.slice("citations", 1, shown), lambda c: T.html_escape(c["text"])), "; ")
    return F.format_string(
        '<div class="%s"><h3>%s. %s</h3><p>%s</p><p>%s</p><p>%s</p></div>',
        F.col("result"), F.col("prop_seq") + 1, F.upper("result"), T.html_escape(T.preview(F.col("text"), 500)), cites, T.html_escape(F.coalesce("explanation", F.lit(""))),
    )


def html_report(validations: DataFrame, shown: int = 3) -> DataFrame:
    """brief_id, html: counts, then a card for each proposition in order with its first
    citations, all text escaped. Write it with `write.text` partitioned by brief_id."""
    cards = validations.withColumn("_card", _card(shown)).groupBy("brief_id").agg(ordered_join("_card", ["prop_seq"], "\n").alias("_cards"))
    page = F.format_string("<html><body><h1>%s</h1><p>verified %s, failed %s, uncertain %s</p>\n%s\n</body></html>", T.html_escape(F.col("brief_id").cast("string")), F.col("verified"), F.col("failed"), F.col("uncertain"), F.col("_cards"))
    return cards.join(validation_summary(validations), "brief_id").select("brief_id", page.alias("html"))


def user_briefs(users: DataFrame, briefs: DataFrame, email: Column | str) -> DataFrame:
    """A user's briefs: brief_id, filename, uploaded_at, processed."""
    own = users.where(F.col("email") == email).select("user_id")
    return briefs.join(own, "user_id", "left_semi").select("brief_id", "filename", "uploaded_at", F.col("processed_at").isNotNull().alias("processed"))


def extraction_metadata(items: DataFrame, block_quotes: DataFrame, sections: DataFrame, margin: DataFrame) -> DataFrame:
    """One row for each brief: its section, margins and the numbers of what was found."""
    n = items.groupBy("brief_id").agg(
        F.count(F.lit(1)).alias("total_citations"), F.count_if(F.col("content_type") == "statement").alias("total_statements"), F.count_if(F.col("content_type") == "quotation").alias("total_inline_quotations")
    )
    b = block_quotes.groupBy("brief_id").agg(F.count(F.lit(1)).alias("total_block_quotations"))
    made = sections.select("brief_id", "start_page", "end_page").join(n, "brief_id", "left").join(b, "brief_id", "left").join(margin, "brief_id", "left")
    return made.fillna(0, ["total_citations", "total_statements", "total_inline_quotations", "total_block_quotations"])
