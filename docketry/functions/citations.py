"""Citation recogniser: typed spans of full, short, id. and supra citations.

Grammar (leftmost, not overlapping; a signal before a party is no part of it):
  full   [Party v. Party,] volume reporter page [, pin] [(court year)]
  short  [Name,] volume reporter at pin
  id     Id. [at pin]
  supra  Name, supra [, [at] pin]
Reporters are those of constants.REPORTER_SLUGS. Every form may be followed at once by an
explanatory parenthetical with balanced brackets.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from docketry.functions.constants import REPORTER_SLUGS, SIGNALS, THAT_VERBS, VERBS

_REPORTER = "|".join(re.escape(r) for r in sorted(REPORTER_SLUGS, key=len, reverse=True))
_PIN = r"\d+(?:[–-]\d+)?(?:\s*n\.\s*\d+)?"
#: What all citations are found by: volume and reporter, id. or supra. Names are looked for before it.
CORE = re.compile(
    rf"(?P<case>(?<!\d)(?P<volume>\d+)\s+(?P<reporter>{_REPORTER})\s+(?:at\s+(?P<pin2>{_PIN})|(?P<page>\d+)(?:,\s*(?P<pin>{_PIN}))?(?:\s*\((?P<court>[^()]*?\b\d{{4}})\))?))"
    rf"|(?P<id>\b[Ii]d\.(?:\s+at\s+(?P<pin3>{_PIN}))?)"
    rf"|(?P<supra>,\s+supra(?:,?\s+(?:at\s+)?(?P<pin4>{_PIN}))?)"
)
_TOKEN = re.compile(r"\S+")
_PARTY_WORD = re.compile(r"(?:[A-Z][\w.'’&-]*|of|the|and|ex|rel\.|&|\[sic\]),?")
_PARTY_START = re.compile(r"[A-Z][\w.'’&-]*,?$")
_NAME = re.compile(r"[A-Z][\w'’-]+$")
CITATION = "struct<text:string,start:int,end:int,cite_type:string,volume:string,reporter:string,page:string,pin_cite:string,plaintiff:string,defendant:string,antecedent:string,court:string,parenthetical:string,paren_end:int>"


def balanced(text: str, at: int, verbs: tuple[str, ...] = VERBS) -> tuple[str | None, int]:
    """An explanatory parenthetical that begins at once: its content and end."""
    found = re.compile(r"\s*\(").match(text, at)
    if not found or not text[found.end() : found.end() + 50].lstrip().lower().startswith(verbs):
        return None, at
    depth = 1
    for m in re.compile(r"[()]").finditer(text, found.end()):
        depth += 1 if m.group() == "(" else -1
        if not depth:
            return text[found.end() : m.start()].strip(), m.end()
    return None, at


def _name_before(text: str, floor: int, end: int) -> int | None:
    """Where the name of a short citation or supra begins that ends at `end`, if one does."""
    at = end
    while at > floor and (text[at - 1].isalnum() or text[at - 1] in "_'’-"):
        at -= 1
    found = _NAME.search(text[at:end])
    return at + found.start() if found and found.group().lower() not in SIGNALS else None


def _party(tokens: list[re.Match], last: int) -> int:
    """The first token of the party that ends with token `last`: all of them are words of
    names. One that only ends as a name's first word does is the last to count."""
    at = last + 1
    while at > 0 and _PARTY_WORD.fullmatch(tokens[at - 1].group()):
        at -= 1
    return at - 1 if at > 0 and _PARTY_START.search(tokens[at - 1].group()) else at


def _begins(tokens: list[re.Match], first: int, last: int) -> tuple[int, int] | None:
    """Token and offset where a party within tokens first to last begins: at a capital, after
    a signal that opens it or a sentence in it."""
    for i in range(first, last):
        signal = tokens[i].group().lstrip("([\"“").rstrip(",").lower() in SIGNALS
        if signal and (i == first or tokens[i - 1].group()[-1] in ".;:"):
            first = i + 1
    for i in range(first, last + 1):
        if found := _PARTY_START.search(tokens[i].group()):
            return i, tokens[i].start() + found.start()
    return None


def _case_before(text: str, floor: int, end: int) -> tuple[int, str | None, str | None] | None:
    """Start, plaintiff and defendant of the case name between `floor` and `end`, if the text
    before `end` is one with its comma. Every token is looked at once or twice."""
    tokens = list(_TOKEN.finditer(text, floor, end))
    last = len(tokens) - 1
    if last < 0 or not text[end - 1].isspace() or not tokens[last].group().endswith(","):
        return None
    first = _party(tokens, last)
    versus = next((i for i in range(last - 1, max(first - 2, -1), -1) if tokens[i].group() == "v."), None)
    if versus is not None and versus > 0 and not tokens[versus - 1].group().endswith(","):
        own, other = _begins(tokens, versus + 1, last), _begins(tokens, _party(tokens, versus - 1), versus - 1)
        if own and own == (versus + 1, tokens[versus + 1].start()) and other:
            return other[1], text[other[1] : tokens[versus - 1].end()], text[own[1] : tokens[last].end() - 1]
    for i in range(max(first, 2), last + 1):
        if tokens[i - 1].group() == "re" and tokens[i - 2].group().endswith("In") and tokens[i].group()[0].isupper():
            start = tokens[i - 2].end() - 2
            return start, text[start : tokens[last].end() - 1], None
    return None


def recognise(text: str | None) -> list[dict]:
    """All citations of a text, in order, in time proportional to it: names are looked for
    between a citation's core and the citation before it."""
    found, floor = [], 0
    text = text or ""
    for m in CORE.finditer(text):
        g, start, plaintiff, defendant, antecedent = m.groupdict(), m.start(), None, None, None
        if g["case"] and g["page"]:
            kind = "full_case"
            if named := _case_before(text, floor, start):
                start, plaintiff, defendant = named
        elif g["case"]:
            kind = "short_case"
            before = text[floor:start].rstrip()
            at = floor + len(before)
            if at < start and before.endswith(",") and (name := _name_before(text, floor, at - 1)) is not None:
                start, antecedent = name, text[name : at - 1]
        elif g["id"]:
            kind = "id"
        else:
            kind, name = "supra", _name_before(text, floor, start)
            if name is None:
                continue
            start, antecedent = name, text[name:start]
        parenthetical, end = balanced(text, m.end())
        found.append(
            {
                "text": text[start : m.end()], "start": start, "end": m.end(), "cite_type": kind,
                "volume": g["volume"], "reporter": g["reporter"], "page": g["page"],
                "pin_cite": g["pin"] or g["pin2"] or g["pin3"] or g["pin4"],
                "plaintiff": plaintiff, "defendant": defendant, "antecedent": antecedent,
                "court": g["court"], "parenthetical": parenthetical, "paren_end": end,
            }
        )
        floor = m.end()
    return found


def _recognised(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(recognise)


def citations(text: Column) -> Column:
    """Array of the citations of a text, in order."""
    return F.pandas_udf(_recognised, f"array<{CITATION}>")(text)


def that_parenthetical(text: Column, end: Column, ahead: int = 200) -> Column:
    """Content of a "(holding that ...)" that begins at `end` (native, without nesting)."""
    verbs = "|".join(THAT_VERBS)
    return F.nullif(F.regexp_extract(F.substring(text, end + 1, F.lit(ahead)), rf"(?i)^\s*\((?:{verbs})\s+that\s+([^)]+)\)", 1), F.lit(""))
