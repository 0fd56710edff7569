"""Case names, keys and paths: Column -> Column, native throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docketry.functions.constants import DEFENDANT_BODIES, PLAINTIFF_BODIES, REPORTER_SLUGS, SIC, VERSUS
from docketry.functions.text import strip, zero_filled


def _surname(side: Column, bodies: tuple[str, ...], unicode: bool) -> Column:
    words = F.split(strip(side, unicode), r"\s+")
    return F.when((F.size(words) > 1) & ~F.lower(words[0]).isin(*bodies), F.element_at(words, -1)).otherwise(side)


def compared_name(name: Column, unicode: bool = True) -> Column:
    """Name for comparison: surnames of both sides; public bodies stay whole; what follows
    the defendant's first comma goes. A name without "v." is only stripped; null is empty."""
    sides = F.split(name, VERSUS, 2)
    plaintiff = _surname(sides[0], PLAINTIFF_BODIES, unicode)
    defendant = _surname(strip(F.split(F.try_element_at(sides, F.lit(2)), ",")[0], unicode), DEFENDANT_BODIES, unicode)
    return F.when(name.isNull() | (name == ""), F.lit("")).when(F.size(sides) == 2, F.concat(plaintiff, F.lit(" v. "), defendant)).otherwise(strip(name, unicode))


def _side(text: Column, unicode: bool) -> Column:
    bare = F.regexp_replace(strip(text, unicode), "[.,;:]+$", "")
    return F.regexp_replace(F.regexp_replace(bare, SIC, ""), r"^\d+\s+", "")


def party_name(plaintiff: Column, defendant: Column, unicode: bool = True) -> Column:
    """"P v. D" from recognised parties, without [sic], page numbers and closing marks; the
    plaintiff alone if there is no defendant; null without a plaintiff."""
    p, d = _side(plaintiff, unicode), _side(F.split(F.coalesce(defendant, F.lit("")), ",")[0], unicode)
    return F.when(F.coalesce(p, F.lit("")) == "", F.lit(None)).when(d == "", p).otherwise(F.concat(p, F.lit(" v. "), d))


def dashed_name(plaintiff: Column, defendant: Column) -> Column:
    """"P v. D" with what follows the plaintiff's last dash, even if D is empty."""
    last = strip(F.element_at(F.split(plaintiff, r"--|—|–"), -1))
    return F.when(F.coalesce(last, F.lit("")) == "", F.lit(None)).otherwise(F.concat(last, F.lit(" v. "), strip(F.coalesce(defendant, F.lit("")))))


def reporter_slug(reporter: Column) -> Column:
    """Folder of a reporter; null if it is not listed."""
    slugs = F.create_map(*[F.lit(x) for pair in REPORTER_SLUGS.items() for x in pair])
    return F.try_element_at(slugs, reporter)


def case_path(base: str, volume: Column, reporter: Column, page: Column, kind: str) -> Column:
    """Where a case's file lies, by reporter, volume and page; null for unlisted reporters."""
    return F.concat(F.lit(f"{base}/"), reporter_slug(reporter), F.lit("/"), volume, F.lit(f"/{kind}/"), zero_filled(page), F.lit(f"-01.{kind}"))


def first_page(citations: Column) -> Column:
    """First page in the first parallel citation that ends with a number."""
    pages = F.transform(citations, lambda c: F.regexp_extract(c, r"(\d+)\s*$", 1).try_cast("int"))
    return F.try_element_at(F.filter(pages, lambda p: p.isNotNull()), F.lit(1))


def first_page_in(citations: Column, reporter: Column) -> Column:
    """First page in the first parallel citation of exactly this reporter."""
    own = F.filter(citations, lambda c: F.regexp_replace(c, r"^\S+\s+|\s+\S+$", "") == reporter)
    return F.try_element_at(F.transform(own, lambda c: F.regexp_extract(c, r"(\S+)$", 1)), F.lit(1))


def volume_and_reporter(citations: Column) -> Column:
    """struct<volume, reporter> of the first parallel citation with three parts or more."""
    parts = F.filter(F.transform(citations, lambda c: F.split(c, r"\s+")), lambda p: F.size(p) >= 3)
    one = F.try_element_at(parts, F.lit(1))
    return F.struct(one[0].alias("volume"), F.array_join(F.slice(one, 2, F.greatest(F.size(one) - 2, F.lit(0))), " ").alias("reporter"))


def pin_page(pin: Column) -> Column:
    return F.regexp_extract(pin, r"(\d+)", 1).try_cast("int")


def plausible_pin(pin: Column, start: Column, limit: int = 20) -> Column:
    """A pin page from the first page to `limit` pages on; true if either is unknown."""
    page = pin_page(pin)
    return F.coalesce(page.between(start, start + limit), F.lit(True))


def opinion_id(url: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(url, "/+$", ""), "/"), -1)
