"""Resolution of citations to case records, by as-of and carry-forward windows.

cites: brief_id, seq (a total order within the brief), cite_type (full_case, short_case,
id, supra, unknown), volume, reporter, page, pin_cite, ... ; records: volume, reporter,
page, record (any struct), one row kept for each key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions.names import pin_page

KEY = ("volume", "reporter", "page")


def _is(kind: str) -> F.Column:
    return F.col("cite_type") == kind


def before(*partition: str) -> Window:
    return Window.partitionBy(*partition).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)


def keys_of(cites: DataFrame) -> DataFrame:
    """Distinct complete keys, for a look-up in one join."""
    whole = [F.col(k).isNotNull() & (F.col(k) != "") for k in KEY]
    return cites.where(whole[0] & whole[1] & whole[2]).select(*KEY).distinct()


def first_records(records: DataFrame, order: Sequence[str]) -> DataFrame:
    """One record for each key: the first by `order`."""
    first = Window.partitionBy(*KEY).orderBy(*order)
    return records.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def attach_records(cites: DataFrame, records: DataFrame) -> DataFrame:
    """Adds `record` to full citations with a known key; null otherwise."""
    found = cites.join(records.select(*KEY, F.col("record").alias("_record")), list(KEY), "left")
    return found.withColumn("record", F.when(_is("full_case"), F.col("_record"))).select(*cites.columns, "record")


def short_as_of(cites: DataFrame) -> DataFrame:
    """Short citations take the record of the latest earlier full citation of the same
    volume and reporter that has one."""
    own = F.last(F.when(_is("full_case"), F.col("record")), True).over(before("brief_id", "volume", "reporter"))
    return cites.withColumn("record", F.when(_is("short_case"), own).otherwise(F.col("record")))


def carried(cites: DataFrame) -> DataFrame:
    """Id. and supra citations take the record of the latest earlier citation with one.
    `ambiguous`: a full citation without a record stands between."""
    held = before("brief_id")
    last_with = F.last(F.when(F.col("record").isNotNull(), F.struct("seq", "record")), True).over(held)
    last_full = F.last(F.when(_is("full_case"), F.col("seq")), True).over(held)
    back = F.col("cite_type").isin("id", "supra")
    return (
        cites.withColumns({"_with": last_with, "_full": last_full})
        .withColumn("ambiguous", back & F.coalesce(F.col("_full") > F.col("_with.seq"), F.lit(False)))
        .withColumn("record", F.when(back, F.col("_with.record")).otherwise(F.col("record")))
        .drop("_with", "_full")
    )


def refers_to(cites: DataFrame, name: str = "case_name", by_unit: bool = False) -> DataFrame:
    """Adds refers_to for id. citations: the name of the last full citation before (by_unit:
    before this unit; needs unit_seq)."""
    if by_unit:
        window = Window.partitionBy("brief_id").orderBy("unit_seq").rangeBetween(Window.unboundedPreceding, -1)
    else:
        window = before("brief_id")
    return cites.withColumn("refers_to", F.when(_is("id"), F.last(F.when(_is("full_case"), F.col(name)), True).over(window)))


def propagate_short(cites: DataFrame, start: str = "start_page") -> DataFrame:
    """Second pass for short citations without a record: the latest full citation of the
    same volume and reporter (one without a record hides those before), unless the page
    lies before the case's first page or is no number."""
    latest = F.last(F.when(_is("full_case"), F.struct("record", F.col(start).alias("start"))), True).over(before("brief_id", "volume", "reporter"))
    fits = F.col("_full.start").isNull() | F.col("page").isNull() | (F.col("page").try_cast("int") >= F.col("_full.start"))
    return (
        cites.withColumn("_full", latest)
        .withColumn("record", F.when(_is("short_case") & F.col("record").isNull(), F.when(fits, F.col("_full.record"))).otherwise(F.col("record")))
        .drop("_full")
    )


def propagate_id(cites: DataFrame, limit: int = 20, start: str = "start_page") -> DataFrame:
    """Second pass for id. citations: the last full or short citation with a record gives
    it, if the pin lies in [first page, first page + limit]; a missing pin is inherited from
    the last full, short (pin or page) or pinned id. citation since."""
    anchor = F.col("cite_type").isin("full_case", "short_case") & F.col("record").isNotNull()
    last = F.last(F.when(anchor, F.struct("record", F.col(start).alias("start"))), True).over(before("brief_id"))
    known = F.max(F.when(anchor, F.lit(True))).over(before("brief_id"))
    cites = cites.withColumns({"_last": last, "_known": known})
    event = F.when(anchor, F.struct(F.coalesce("pin_cite", "page").alias("pin"))).when(_is("id") & F.col("_known") & F.col("pin_cite").isNotNull(), F.struct(F.col("pin_cite").alias("pin")))
    cites = cites.withColumn("_pin", F.last(event, True).over(before("brief_id")))
    page = pin_page(F.col("pin_cite"))
    fits = page.isNull() | F.col("_last.start").isNull() | page.between(F.col("_last.start"), F.col("_last.start") + limit)
    take = _is("id") & F.col("record").isNull() & F.col("_known") & fits
    return (
        cites.withColumn("record", F.when(take, F.col("_last.record")).otherwise(F.col("record")))
        .withColumn("pin_cite", F.when(_is("id") & F.col("_known"), F.coalesce("pin_cite", "_pin.pin")).otherwise(F.col("pin_cite")))
        .drop("_last", "_known", "_pin")
    )


def resolve(cites: DataFrame, records: DataFrame, limit: int = 20) -> DataFrame:
    """All steps. records: volume, reporter, page, record, start_page. One exchange on the
    key for the look-up and one on brief_id for all windows."""
    found = cites.join(records.select(*KEY, F.col("record").alias("_record"), "start_page"), list(KEY), "left")
    found = found.withColumn("record", F.when(_is("full_case"), F.col("_record"))).select(*cites.columns, "record", "start_page")
    return refers_to(propagate_id(propagate_short(carried(short_as_of(found))), limit))


def string_groups(cites: DataFrame) -> DataFrame:
    """String citations: adds group (running count of citations that open one) and the
    proposition, taken from the last that has its own. Needs is_string_cite, proposition."""
    here = Window.partitionBy("brief_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return cites.withColumns(
        {
            "string_cite_group": F.sum((~F.col("is_string_cite")).cast("int")).over(here),
            "proposition": F.coalesce(F.when(~F.col("is_string_cite"), F.col("proposition")), F.last(F.when(~F.col("is_string_cite"), F.col("proposition")), True).over(before("brief_id"))),
        }
    )


def preceding_start(cites: DataFrame) -> DataFrame:
    """Adds actual_start: from where text belongs to a citation - the end of the one before
    (of its parenthetical, if any) or the sentence's start, whichever is later."""
    order = Window.partitionBy("brief_id").orderBy("seq")
    return cites.withColumn("actual_start", F.greatest(F.lag(F.coalesce("paren_end", "end"), 1, 0).over(order), F.col("sentence_start")))


def path_status(cites: DataFrame, files: DataFrame) -> DataFrame:
    """Adds status of each citation's case file. files: path. Needs json_path, cluster_id.
    A cluster counts once in a brief, at its first citation."""
    first = Window.partitionBy("brief_id", "cluster_id").orderBy("seq")
    marked = cites.join(files.select(F.col("path").alias("_path")).distinct(), F.col("json_path") == F.col("_path"), "left")
    repeat = F.col("cluster_id").isNotNull() & (F.row_number().over(first) > 1)
    status = F.when(F.col("cluster_id").isNull(), "no_record").when(repeat, "processed").when(F.col("json_path").isNull(), "no_path").when(F.col("_path").isNull(), "missing").otherwise("found")
    return marked.withColumn("status", status).select(*cites.columns, "status")


STATUSES = ("found", "missing", "no_path", "no_record", "processed")


def path_stats(statuses: DataFrame) -> DataFrame:
    """One row for each brief with a count of each status."""
    return statuses.groupBy("brief_id").agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])
