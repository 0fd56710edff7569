"""Verification of propositions against the cited cases."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from docketry.functions import text as T
from docketry.functions.names import pin_page

#: Characters of quotations that one automaton holds.
BLOCK = 2_000_000
#: Automata that are sent out at once.
TOGETHER = 8


def occurs(quote: Column, text: Column, unicode: bool = True) -> Column:
    """The quotation stands in the text: in matching form, or without punctuation."""
    q, t = T.matching_text(quote, unicode), T.matching_text(text, unicode)
    return F.contains(t, q) | F.contains(T.unpunctuated(t, unicode), T.unpunctuated(q, unicode))


def verify_keyed(quotes: DataFrame, cases: DataFrame, key: str = "case_id") -> DataFrame:
    """quotes (case_id, quote, page_text or null) joined to cases (case_id, text): adds
    found: on the page, else anywhere in the case."""
    joined = quotes.join(cases.select(key, F.col("text").alias("_text")), key, "left")
    found = F.coalesce(occurs(F.col("quote"), F.col("page_text")), F.lit(False)) | F.coalesce(occurs(F.col("quote"), F.col("_text")), F.lit(False))
    return joined.withColumn("found", found).drop("_text")


def _finder(needles: Broadcast) -> Callable:
    """A function from texts to the keys of the needles in each; needles: (key, text)."""

    def search(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for key, needle in needles.value:
            automaton.add_word(needle, (*automaton.get(needle, ()), key))
        automaton.make_automaton()
        for some in batches:
            yield pd.Series([list({k for _, keys in automaton.iter(t) for k in keys}) if t else [] for t in some])

    return search


def verify_anywhere(quotes: DataFrame, texts: DataFrame, quote_id: str, quote: str, text_id: str, text: str, unicode: bool = False, block: int = BLOCK, together: int = TOGETHER) -> DataFrame:
    """Pairs (quote_id, text_id) where the quotation occurs in the text in matching form.

    There is no join key. Quotations are dealt by hash to blocks of about `block` characters;
    a block becomes one automaton that finds all its quotations in a single pass over a text,
    so no pair is compared, no text is shuffled, and the time does not depend on how many
    quotations a block has. Up to `together` blocks are sent out at once; more take rounds,
    whose pairs are checkpointed (spark.checkpoint.dir) before the blocks are released, so
    the memory needed does not grow with the quotations. An empty quotation matches nothing.
    """
    q = quotes.select(F.col(quote_id).alias("_q"), T.matching_text(F.col(quote), unicode).alias("_quote")).where("_quote <> ''")
    blocks = max(1, -(-q.agg(F.coalesce(F.sum(F.length("_quote")), F.lit(0))).first()[0] // block))
    numbered = q.withColumn("_block", F.pmod(F.xxhash64("_quote"), F.lit(blocks)))
    kind, context = ArrayType(quotes.schema[quote_id].dataType), quotes.sparkSession.sparkContext
    pairs = None
    for begin in range(0, blocks, together):
        rows = texts.select(F.col(text_id), T.matching_text(F.col(text), unicode).alias("_text"), F.array().cast(kind).alias("_found"))
        sent = []
        for number in range(begin, min(begin + together, blocks)):
            sent.append(context.broadcast([(r["_q"], r["_quote"]) for r in numbered.where(F.col("_block") == number).collect()]))  # about `block` characters
            rows = rows.withColumn("_found", F.concat("_found", F.pandas_udf(_finder(sent[-1]), kind)(F.col("_text"))))
        found = rows.select(F.explode("_found").alias(quote_id), text_id)
        if blocks <= together:
            return found
        found = found.checkpoint()
        for x in sent:
            x.destroy()
        pairs = found if pairs is None else pairs.unionByName(found)
    return pairs


def case_text(cases: DataFrame, html: DataFrame | None = None) -> DataFrame:
    """cases (path, casebody struct) -> path, text: the opinions, else the page's text.
    html: path (ending in .html, else as the case's), value."""
    texts = F.filter(F.transform("casebody.opinions", lambda o: o["text"]), lambda x: x.isNotNull() & (x != ""))
    own = cases.select("path", F.nullif(F.array_join(texts, "\n\n"), F.lit("")).alias("_json"))
    if html is None:
        return own.select("path", F.col("_json").alias("text"))
    other = html.select(F.regexp_replace(F.regexp_replace("path", "/html/", "/json/"), r"\.html$", ".json").alias("path"), T.html_text(F.col("value"), every_entity=True).alias("_html"))
    return own.join(other, "path", "left").select("path", F.coalesce("_json", "_html").alias("text"))


def _every_entity(piece: Column) -> Column:
    return T.html_text(piece, every_entity=True)


def case_pages(html: DataFrame, window: int = 5000, as_text: Callable[[Column], Column] = _every_entity) -> DataFrame:
    """path, page, text: a case's pages, cut once at their anchors (id="pN", or *N as their
    text), for an equi-join on the page. A page goes to the next one's anchor, whatever other
    anchors stand between; where there is none behind its own, it is `window` characters from
    there on. The first anchor of a page counts. All of it happens within a row, so no text
    is shuffled. as_text makes a page's text from its piece of the file."""
    anchor = r'(?s)^(<a[^>]*\bid="p(\d+)"[^>]*>.*?</a>|<a[^>]*>\*(\d+)</a>)'
    number = lambda piece: F.coalesce(F.nullif(F.regexp_extract(piece, anchor, 2), F.lit("")), F.nullif(F.regexp_extract(piece, anchor, 3), F.lit(""))).cast("int")
    pieces = T.once(F.split("value", r'(?=<a[^>]*\bid="p\d+")|(?=<a[^>]*>\*\d+</a>)'), lambda x: F.struct(x.alias("pieces"), F.transform(x, number).alias("pages"), T.running(F.transform(x, lambda y: F.length(y).cast("long"))).alias("ends")))

    def piece(c: Column, i: Column) -> Column:
        page, after = c["pages"][i], F.array_position(c["pages"], c["pages"][i] + 1) - i - 1
        after = F.when(after > 0, after).otherwise(F.array_position(F.slice(c["pages"], i + 2, F.size(c["pages"])), page + 1)).cast("int")
        far = F.substring("value", (c["ends"][i] - F.length(c["pieces"][i]) + 1).cast("int"), F.lit(window))
        return F.struct(page.alias("page"), T.once(after, lambda n: F.when(n > 0, F.array_join(F.slice(c["pieces"], i + 1, n), "")).otherwise(far)).alias("piece"))

    first = lambda c: F.filter(F.sequence(F.lit(0), F.size(c["pieces"]) - 1), lambda i: F.array_position(c["pages"], c["pages"][i]) == i + 1)
    rows = html.where("value IS NOT NULL").select("path", F.explode(T.once(pieces, lambda c: F.transform(first(c), lambda i: piece(c, i)))).alias("p"))
    return rows.select("path", "p.page", as_text(F.col("p.piece")).alias("text"))


def first_local(citations: Column) -> Column:
    """The first citation with a local file."""
    return F.try_element_at(F.filter(citations, lambda c: c["local_json_path"].isNotNull()), F.lit(1))


def _overlap(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for claims, texts in batches:
        out = []
        for claim, text in zip(claims, texts, strict=True):
            words = {w for w in (claim or "").lower().split() if len(w) > 3}
            held = set((text or "").lower().split())
            out.append("verified" if words and len(words & held) >= 0.9 * len(words) else "uncertain")
        yield pd.Series(out)


def token_overlap(claim: Column, text: Column) -> Column:
    """Default scorer: verified if nearly all of a proposition's words stand in the text,
    else uncertain; a word count alone never fails a proposition."""
    return F.pandas_udf(_overlap, "string")(claim, text)


def verdict_of(reply: Column) -> Column:
    """Verdict of a scorer's reply by the first line's own word, so UNVERIFIED is none."""
    head = F.upper(F.substring_index(reply, "\n", 1))
    return F.when(head.rlike(r"^\W*VERIFIED\b"), "verified").when(head.rlike(r"^\W*(FAILED|NOT\s+VERIFIED|UNVERIFIED)\b"), "failed").otherwise("uncertain")


def validate(props: DataFrame, cases: DataFrame, pages: DataFrame, scorer=token_overlap, context: int = 15_000, least: int = 20) -> DataFrame:
    """Adds result and explanation. props: text, type, citations (structs with
    local_json_path, pin_cite). Only what no text search decides goes to the scorer."""
    cite = first_local(F.col("citations"))
    own = props.withColumns({"_path": cite["local_json_path"], "_page": pin_page(cite["pin_cite"])})
    own = own.join(cases.select(F.col("path").alias("_path"), F.col("text").alias("_case")), "_path", "left")
    own = own.join(pages.select(F.col("path").alias("_path"), F.col("page").alias("_page"), F.col("text").alias("_on_page")), ["_path", "_page"], "left")
    inner = F.filter(T.quotations(F.col("text")), lambda q: F.length(q) >= least)
    quotes = F.when(F.col("type") == "block_quote", F.concat(F.array("text"), inner)).otherwise(inner)
    hit = F.exists(quotes, lambda q: F.coalesce(occurs(q, F.col("_on_page")), F.lit(False)) | F.coalesce(occurs(q, F.col("_case")), F.lit(False)))
    quoted = T.is_quote(F.col("text"), F.col("type"))
    verdict = lambda result, why: F.struct(F.lit(result).alias("result"), F.lit(why).alias("explanation"))
    decided = (
        F.when(F.coalesce(F.size("citations"), F.lit(0)) <= 0, verdict("uncertain", "no citations"))
        .when(F.col("_path").isNull(), verdict("uncertain", "no local case file"))
        .when(F.col("_case").isNull(), verdict("uncertain", "case text cannot be read"))
        .when(quoted & hit, verdict("verified", "quotation found"))
    )
    own = own.withColumn("_decided", decided)
    done = own.where(F.col("_decided").isNotNull()).withColumns({"result": F.col("_decided.result"), "explanation": F.col("_decided.explanation")})
    left = own.where(F.col("_decided").isNull()).withColumn("result", scorer(F.col("text"), F.left(F.coalesce("_on_page", "_case"), F.lit(context)))).withColumn("explanation", F.lit("scored"))
    return done.select(*props.columns, "result", "explanation").unionByName(left.select(*props.columns, "result", "explanation"))
