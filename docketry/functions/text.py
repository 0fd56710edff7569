"""Text functions: Column -> Column, native throughout.

`unicode` chooses between Unicode white space and word characters (the default) and the
ASCII classes that other engines' regular expressions share.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from docketry.functions.constants import ABBREVIATIONS, ANNOTATION, BRACKETED, CITATION_CORE, MORE_ABBREVIATIONS, SENTENCE_GAP, SIGNALS, SPLIT_LINE_WORD, SPLIT_WORD, TAG

OPEN, CLOSE = "“", "”"
QUOTES = f'["{OPEN}{CLOSE}]'


def _flag(unicode: bool) -> str:
    return "(?U)" if unicode else ""


def alternatives(words, key=len) -> str:
    """Words as a regular expression, longest first."""
    return "|".join(re.sub(r"([.\\+*?\[^\]$(){}=!<>|:#\-])", r"\\\1", w) for w in sorted(words, key=lambda w: (-len(w), w)))


def strip(text: Column, unicode: bool = True) -> Column:
    return F.regexp_replace(text, _flag(unicode) + r"^\s+|\s+$", "")


def collapse(text: Column, unicode: bool = True) -> Column:
    """One space for each run of white space, none at the ends."""
    return F.trim(F.regexp_replace(text, _flag(unicode) + r"\s+", " "))


def present(text: Column) -> Column:
    """Null for blank strings too."""
    return F.nullif(strip(text), F.lit(""))


def recogniser_text(text: Column, dashes: bool = True, unicode: bool = True) -> Column:
    """Normal form before recognition: dashes spelt out, white space collapsed, underscore runs dropped."""
    spelt = F.regexp_replace(text, "[–—]", " -- ") if dashes else text
    return F.regexp_replace(F.regexp_replace(spelt, _flag(unicode) + r"\s+", " "), "__+", "")


def join_hyphens(text: Column, unicode: bool = True) -> Column:
    """Words split by a hyphen and white space are joined, then white space is collapsed."""
    return collapse(F.regexp_replace(text, _flag(unicode) + SPLIT_WORD, "$1$2"), unicode)


def join_line_hyphens(text: Column) -> Column:
    """As join_hyphens, only across a line's end."""
    return F.regexp_replace(text, "(?U)" + SPLIT_LINE_WORD, "$1$2")


def matching_text(text: Column, unicode: bool = True) -> Column:
    """Normal form for verbatim matching: straight quotes, spaced ellipses, no bracketed
    insertions, plain dashes, single spaces, lower case."""
    w = _flag(unicode)
    straight = F.translate(collapse(text, unicode), "“”‘’", "\"\"''")
    dots = F.regexp_replace(F.regexp_replace(straight, r"\.{3,}", "..."), w + r"\s*\.\.\.\s*", " ... ")
    bare = F.regexp_replace(dots, BRACKETED, "")
    return F.lower(collapse(F.regexp_replace(bare, "[–—]", "-"), unicode))


def unpunctuated(text: Column, unicode: bool = True) -> Column:
    return F.regexp_replace(text, _flag(unicode) + r"[^\w\s]", "")


#: Entities that are decoded natively; the ampersand comes last.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&#x27;": "'", "&nbsp;": " ", "&middot;": "·", "&copy;": "©", "&sect;": "§", "&mdash;": "—", "&ndash;": "–", "&ldquo;": OPEN, "&rdquo;": CLOSE, "&lsquo;": "‘", "&rsquo;": "’", "&amp;": "&"}


def _unescaped(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(html.unescape, na_action="ignore")


def html_text(page: Column, unicode: bool = True, every_entity: bool = False, space: str | None = None) -> Column:
    """Tags become spaces, entities characters, white space single spaces. The entities are
    those of ENTITIES, native; with every_entity all named and numeric ones, by Arrow. space:
    a pattern for runs of white space, instead of the usual ones."""
    out = F.regexp_replace(page, TAG, " ")
    if every_entity:
        out = F.pandas_udf(_unescaped, "string")(out)
    else:
        for entity, character in ENTITIES.items():
            out = F.replace(out, F.lit(entity), F.lit(character))
    return F.trim(F.regexp_replace(out, space, " ")) if space else collapse(out, unicode)


def html_escape(text: Column) -> Column:
    out = text
    for character, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(character), F.lit(entity))
    return out


def zero_filled(page: Column, width: int = 4) -> Column:
    """Zeros before a shorter text; a longer one stays whole."""
    return F.when(F.length(page) < width, F.lpad(page, width, "0")).otherwise(page)


def preview(text: Column, length: int) -> Column:
    return F.when(F.length(text) > length, F.concat(F.left(text, F.lit(length)), F.lit("..."))).otherwise(text)


#: A two-letter initial such as U. before S. goes on; so does N. before Y. and the like.
INITIALS = r"(?<=(?<![\p{L}\p{N}.\-])[UNSEWunsew]\.)(?=\s*[SYEWTCsyewtc]\.)"


def _boundary(ahead: str) -> str:
    """Between sentences: after . ! or ?, the space and before one of `ahead`, unless an
    abbreviation or initials end there."""
    guard = "".join(f"(?<!(?<![\\p{{L}}\\p{{N}}.\\-])(?i:{alternatives(g)}))" for g in _by_length(ABBREVIATIONS))
    return rf"(?<=[.!?]){guard}(?!{INITIALS})\s*(?=[{ahead}])"


def sentences(text: Column) -> Column:
    """Array of sentences. A boundary stands after . ! or ? before a capital letter or a
    quotation mark (a closing one too), unless an abbreviation or initials end there."""
    parts = F.transform(F.split(text, _boundary(r"\p{Lu}\"'“”‘’")), lambda s: strip(s))
    return F.filter(parts, lambda s: F.length(s) > 0)


def _by_length(words) -> list[list[str]]:
    found: dict[int, list[str]] = {}
    for w in words:
        if w.endswith("."):
            found.setdefault(len(w), []).append(w)
    return [found[k] for k in sorted(found)]


def is_abbreviation(word: Column) -> Column:
    """The wide test: a listed abbreviation, a number with letters, or one letter, with its full stop."""
    low = F.lower(word)
    return low.isin(*ABBREVIATIONS, *MORE_ABBREVIATIONS) | low.rlike(r"^\d+[a-z]*\.") | low.rlike(r"^\p{L}.$")


def signal_before(prefix: Column) -> Column:
    """The longest signal that ends a citation's 30-character look-back; null without one.
    A word's end counts: "oversee" ends with "see"."""
    tail = F.lower(F.regexp_replace(F.right(prefix, F.lit(30)), r"\s+$", ""))
    return F.nullif(F.regexp_extract(tail, f"({alternatives(SIGNALS)})$", 1), F.lit(""))


def signal_at_end(text: Column) -> Column:
    """A signal that ends a text, at a word's start."""
    return F.nullif(F.lower(F.regexp_extract(text, rf"(?i)\b({alternatives(SIGNALS)})\s*$", 1)), F.lit(""))


def without_signal(text: Column) -> Column:
    return strip(F.regexp_replace(text, rf"(?i)\b({alternatives(SIGNALS)})\s*$", ""))


def quotations(text: Column) -> Column:
    """Texts between double quotation marks, straight or curly."""
    return F.regexp_extract_all(text, F.lit(f'{QUOTES}([^"{OPEN}{CLOSE}]+){QUOTES}'), F.lit(1))


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is evaluated once, however often f uses it."""
    return F.transform(F.array(value), f)[0]


def running(numbers: Column, step: int = 64) -> Column:
    """For each of an array of whole numbers, the sum up to and with it; by blocks of `step`,
    so that thousands of numbers cost little more than a few."""
    total = lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda s, x: s + x)
    block = lambda i: F.floor(i / step).cast("int")

    def of(own: Column) -> Column:
        sums = F.transform(F.sequence(F.lit(0), F.greatest(block(F.size(own) - 1), F.lit(0))), lambda b: total(F.slice(own, b * step + 1, F.lit(step))))
        return once(sums, lambda made: once(F.transform(made, lambda x, i: total(F.slice(made, F.lit(1), i))), lambda before: F.transform(own, lambda x, i: before[block(i)] + total(F.slice(own, block(i) * step + 1, i % step + 1)))))

    return once(numbers, of)


def _pieces(text: Column, pattern: str) -> Column:
    """The pieces between a pattern's matches, the matches, and where each match ends."""
    cut = F.struct(F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    return once(cut, lambda c: F.struct(c["pieces"].alias("pieces"), c["found"].alias("found"), running(F.transform(c["found"], lambda m, i: (F.length(c["pieces"][i]) + F.length(m)).cast("long"))).alias("ends")))


def quoted_spans(text: Column) -> Column:
    """array<struct<quoted, start, end>> of the quotations, marks included, in code points."""
    cut = _pieces(text, f'{QUOTES}[^"{OPEN}{CLOSE}]+{QUOTES}')
    return once(cut, lambda c: F.transform(c["found"], lambda m, i: F.struct(m.alias("quoted"), (c["ends"][i] - F.length(m)).cast("int").alias("start"), c["ends"][i].cast("int").alias("end"))))


def quote_share(text: Column) -> Column:
    """Characters inside quotations over all characters."""
    inside = F.aggregate(quotations(text), F.lit(0), lambda a, q: a + F.length(q))
    return inside / F.greatest(F.length(text), F.lit(1))


def has_quotation(text: Column, least: int = 15) -> Column:
    return text.rlike(f'["{OPEN}][^"{CLOSE}]{{{least},}}["{CLOSE}]')


def is_quote(text: Column, kind: Column, share: float = 0.4) -> Column:
    """A block quotation, or a text of which over `share` is quoted."""
    return (kind == "block_quote") | (quote_share(text) > share)


def without_annotation(text: Column) -> Column:
    """Without a leading "(emphasis added)", "(cleaned up)" and the like."""
    return F.regexp_replace(text, ANNOTATION, "")


_PAGES = r"\d+(?:[–-]\d+)?"
_LEADING = (
    rf"id\.(?:\s+at\s+{_PAGES})?"
    rf"|[a-z]+(?:\s+v\.\s+[a-z]+)?,\s*\d+\s+[a-z][a-z.]*(?:\d+[a-z]*)?\s+(?:at\s+)?{_PAGES}"
    rf"|[a-z]+,\s*supra(?:,?\s+at\s+{_PAGES})?"
)


def without_leading_citations(text: Column) -> Column:
    """Without citations carried over from before, connectives between them, or a text that
    is nothing but a signal."""
    body = strip(F.regexp_replace(text, rf"(?i)^(?:(?:(?:{_LEADING})[;,.\s]*|(?:and|or)[;,.\s]+))+", ""))
    return F.when(body.rlike(r"(?i)^(?:see\s+also|see|accord|cf\.|but\s+see|e\.g\.,?)[;,.\s]*$"), F.lit("")).otherwise(body)


def is_string_cite(between: Column) -> Column:
    """Nothing but a connective stands between two citations."""
    bare = F.lower(F.regexp_replace(between, r"^[;,.\s]+|[;,.\s]+$", ""))
    return bare.isin("", "and", "or", "but")


def needs_review(signal: Column, parenthetical: Column) -> Column:
    return signal.isNotNull() & parenthetical.isNull()


def content_type(text: Column, in_block: Column) -> Column:
    return F.when(in_block, "block_quotation").when(F.size(quotations(text)) > 0, "quotation").otherwise("statement")


def boundaries(text: Column) -> Column:
    """Offsets (code points) just after each sentence's closing mark and the space behind it,
    where a capital follows."""
    return once(_pieces(text, _boundary(r"\p{Lu}")), lambda c: c["ends"])


def _closed(text: Column, end: Column) -> Column:
    """What stands before `end` closes a sentence, whatever follows there."""
    guard = "|".join(alternatives(g) for g in _by_length(ABBREVIATIONS))
    tail = F.regexp_replace(F.substring(text, F.greatest(end - 39, F.lit(1)), F.least(end, F.lit(40))), r"\s+$", "")
    return tail.rlike(r"[.!?]$") & ~tail.rlike(rf"(?<![\p{{L}}\p{{N}}.\-])(?i:{guard})$")


def unit_start_in(found: Column, text: Column, end: Column, back: int = 2, window: int | None = None) -> Column:
    """unit_start with the text's boundaries at hand."""
    before = F.filter(found, lambda b: b < end)
    closing = F.when(_closed(text, end), F.lit(1)).otherwise(F.lit(0))  # the boundary at `end` itself
    start = F.coalesce(F.try_element_at(before, closing - back), F.lit(0).cast("long")) if back > 1 else F.when(closing == 1, end).otherwise(F.coalesce(F.try_element_at(before, F.lit(-1)), F.lit(0).cast("long")))
    return (F.greatest(start, end - window, F.lit(0)) if window else start).cast("int")


def unit_start(text: Column, end: Column, back: int = 2, window: int | None = None) -> Column:
    """Where the unit before `end` begins: the back-th boundary from there backwards (0
    without one), at most `window` characters away. A closing mark right before `end`
    counts as a boundary, whatever follows it."""
    return once(boundaries(text), lambda found: unit_start_in(found, text, end, back, window))


def search_chunks(text: Column, most: int = 50) -> Column:
    """Pieces to look for on a page: the sentences, each cut at a space to `most` characters."""
    plain = collapse(text)
    cut = lambda s: F.left(s, F.lit(most))
    head = lambda s: F.regexp_extract(cut(s), rf"^(.{{{most // 2 + 1},}}) ", 1)
    short = lambda s: F.when(F.length(s) <= most, s).when(head(s) != "", strip(head(s))).otherwise(strip(cut(s)))
    pieces = F.filter(F.transform(F.split(plain, SENTENCE_GAP), lambda s: strip(s)), lambda s: s != "")
    return F.when(plain == "", F.array().cast("array<string>")).when(F.length(plain) <= most, F.array(plain)).otherwise(F.transform(pieces, short))


def search_terms(citation: Column) -> Column:
    """Terms to look for, most specific first: a short citation whole, the reporter's part,
    the beginning of a long one."""
    plain = collapse(citation)
    core = F.nullif(F.regexp_extract(citation, CITATION_CORE, 0), F.lit(""))
    head = F.left(plain, F.lit(30))
    cut = F.nullif(F.regexp_extract(head, "^(.{16,}) ", 1), F.lit(""))
    return F.array_compact(F.array(F.when(F.length(plain) <= 30, plain), core, F.when(F.length(plain) > 30, F.coalesce(cut, head))))


def ends_sentence(word: Column, following: Column) -> Column:
    """A word of a page that ends a sentence: a mark, no abbreviation, a capital after it."""
    marked = word.rlike("[.!?][\"'”’)]*$") & ~F.lower(word).isin(*ABBREVIATIONS)
    return marked & (following.isNull() | following.rlike(r"^[\p{Lu}\"“(]"))
