"""Secret scans, in DataFrame functions only.

Base patterns: assignments to password-like names, access keys and long hexadecimal runs.
The method adds other tokens that look random. Tokens are runs of at least MIN_LENGTH
characters in what the base assignments leave of a text; those that hold another base span,
and decimal numbers, are left out. Each gets an inferred encoding (hex, base32, base64) and
tests of the hypothesis that its symbols are drawn evenly and independently: chi-squared
over the alphabet, chi-squared over the alphabet's classes (capitals, small letters, digits,
signs), runs above and below the middle of the alphabet, and lag-1 serial correlation. The
least of the four probabilities, times four, is its p: spread evenly, or above that, for
random tokens, and tiny for ordinary ones.

A token is reported if it passes as random (p of MISSED or more, so about that share of
random tokens is missed, and up to six times that among the shortest) and if false discoveries are under control: in each encoding and
doubling of length, p is compared with the p of ordinary strings of that length, made of
every text's own words (run together as in identifiers, or spelt in hexadecimal). The share
of ordinary strings at or above a token's p is its probability under "ordinary", and the
Benjamini-Hochberg procedure on these keeps ordinary tokens to a share of RATE of those
reported. Where the ordinary strings are too few to tell, nothing is reported.

The corpus-wide step is a histogram of p by stratum (a few thousand rows at most), so the
cut is exact to a 1/BINS part of a decade.

Spans are code points, end exclusive. Defined cases: a null text is empty and has no
spans; equal rows get equal results; texts of any length and with any number of matches are
scanned whole, in time proportional to both (running sums go up by blocks of STEP, and a
long token is summed piece by piece); an empty table gives an empty table. Only the named
columns are read.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm.base import materialize

# The base patterns.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"  # 20 characters or more
HEX = "[0-9a-f]{24,}"
MIN_VALUE = 6

MIN_LENGTH = 20
TOKEN = "[A-Za-z0-9+/_-]{%d,}={0,2}" % MIN_LENGTH
#: A token with such a run in it overlaps a base span of these kinds.
HELD = f"{ACCESS}|{HEX}"
#: Share of ordinary tokens among those reported, at most, and of random ones that are missed.
RATE, MISSED = 0.05, 0.01
#: Characters of the ordinary strings, one length for each doubling; longer tokens are held against the last.
ORDINARY = (24, 40, 80)
#: Sums of runs of so many numbers are added up first.
STEP = 64
#: Characters of a token that are taken apart at a time.
PIECE = 1 << 14
#: Histogram bins of a decade of p, and decades.
BINS, DECADES = 20, 12
#: Kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "random")
# Alphabets in their usual order.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
#: First digit and size of the classes of an alphabet.
CLASSES = {"hex": ((0, 10), (10, 6)), "base32": ((0, 26), (26, 6)), "base64": ((0, 26), (26, 26), (52, 10), (62, 2))}
#: A word that ordinary strings are made of.
WORD = r"(?<!\S)[A-Za-z]{2,15}(?!\S)"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _with(name: str, value: str, body: str) -> str:
    """body, in which `name` stands for value, evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _before(numbers: str) -> str:
    """For each of an array of longs, the sum of those before it."""
    add = "0L, (s, y) -> s + y"
    sums = lambda v: f"transform(sequence(0, CAST((size({v}) - 1) div {STEP} AS INT)), b -> aggregate(slice({v}, b * {STEP} + 1, {STEP}), {add}))"
    fine = lambda v, w: f"transform({v}, (x, i) -> {w}[i div {STEP}] + aggregate(slice({v}, CAST(i div {STEP} AS INT) * {STEP} + 1, i % {STEP}), {add}))"
    top = f"transform(a2, (x, i) -> aggregate(slice(a2, 1, i), {add}))"
    return _with("a0", numbers, _with("a1", sums("a0"), _with("a2", sums("a1"), _with("b2", top, _with("b1", fine("a1", "b2"), fine("a0", "b1"))))))


def _cut(text: str, pattern: str, group: int) -> str:
    """The text's pieces between matches, the matches and their given group."""
    q = _quoted(pattern)
    found = f"regexp_extract_all({text}, {q}, 0)"
    value = f"regexp_extract_all({text}, {q}, {group})" if group else found
    return f"named_struct('pieces', split({text}, {q}, -1), 'found', {found}, 'value', {value})"


#: No spans.
NONE = "CAST(array() AS ARRAY<STRUCT<start: BIGINT, end: BIGINT, value: STRING>>)"


def located(text: str, pattern: str, group: int = 0) -> Column:
    """array<struct<start, end, value>> of all matches, leftmost and not overlapping.

    The text is split at the matches; the lengths of pieces and matches add up to places.
    value is the match's given group.
    """
    sizes = "transform(x.found, (m, i) -> CAST(length(x.pieces[i]) + length(m) AS BIGINT))"
    spans = "transform(x.found, (m, i) -> named_struct('start', at[i] + length(x.pieces[i]), 'end', at[i] + length(x.pieces[i]) + length(m), 'value', x.value[i]))"
    return F.expr(f"CASE WHEN {text} RLIKE {_quoted(pattern)} THEN {_with('x', _cut(text, pattern, group), _with('at', _before(sizes), spans))} ELSE {NONE} END")


def blanked(text: str, pattern: str, group: int, least: int) -> Column:
    """The text with spaces for each match whose group has `least` characters."""
    own = f"CASE WHEN i >= size(x.found) THEN '' WHEN length(x.value[i]) >= {least} THEN repeat(' ', length(x.found[i])) ELSE x.found[i] END"
    made = _with("x", _cut(text, pattern, group), f"array_join(transform(x.pieces, (p, i) -> concat(p, {own})), '')")
    return F.expr(f"CASE WHEN {text} RLIKE {_quoted(pattern)} THEN {made} ELSE {text} END")


def ordinary(text: str) -> Column:
    """A string of one of the lengths in ORDINARY made of a text's words, in one of five ways,
    from a word on, all as the text's hash has it; too few words are repeated."""
    words = f"regexp_extract_all({text}, {_quoted(WORD)}, 0)"
    chosen = f"transform(sequence(0, {max(ORDINARY) // 2}), i -> words[CAST((pmod(xxhash64({text}), size(words)) + i) % size(words) AS INT)])"
    joined = f"""CASE pmod(xxhash64({text}, 1), 5) WHEN 0 THEN array_join(transform(chosen, x -> initcap(x)), '') WHEN 1 THEN lower(array_join(chosen, '_'))
        WHEN 2 THEN upper(array_join(chosen, '_')) WHEN 3 THEN upper(array_join(chosen, '')) ELSE lower(hex(array_join(chosen, ' '))) END"""
    size = f"array({', '.join(map(str, ORDINARY))})[CAST(pmod(xxhash64({text}, 2), {len(ORDINARY)}) AS INT)]"
    made = f"array(named_struct('start', 0L, 'end', 0L, 'value', left(joined, {size})))"
    return F.expr(_with("words", words, f"CASE WHEN size(words) = 0 THEN {NONE} ELSE {_with('chosen', chosen, _with('joined', joined, made))} END"))


def _tail(z: str) -> str:
    """P(|N| > z), z >= 0, by the rational approximation 7.1.26 of Abramowitz and Stegun."""
    t = f"(1 / (1 + 0.3275911D * ({z}) / sqrt(2D)))"
    return f"({t} * (0.254829592D + {t} * (-0.284496736D + {t} * (1.421413741D + {t} * (-1.453152027D + {t} * 1.061405429D)))) * exp(-({z}) * ({z}) / 2))"


def _chi_tail(chi: str, freedom: str) -> str:
    """Upper tail of chi-squared, by Wilson and Hilferty."""
    f = f"(2 / (9 * {freedom}))"
    z = f"greatest(0D, (pow(greatest({chi}, 0D) / {freedom}, 1D / 3) - (1 - {f})) / sqrt({f}))"
    return f"({_tail(z)} / 2)"


def tested(tokens: str) -> Column:
    """The tokens with encoding, length n and p; decimal numbers are left out."""
    named = f"""transform(filter({tokens}, c -> NOT c.value RLIKE '^[0-9]+$'), c -> named_struct('start', c.start, 'end', c.end, 'code',
        CASE WHEN c.value RLIKE '^([0-9a-f]+|[0-9A-F]+)$' THEN 'hex' WHEN c.value RLIKE '^[A-Z2-7]+=*$' THEN 'base32' ELSE 'base64' END, 'value', rtrim('=', c.value)))"""
    by_code = lambda values: "CASE c.code " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + " END"
    alphabet = by_code({k: f"'{a}'" for k, a in ALPHABETS.items()})
    halves = by_code({k: f"'{'0' * (len(a) // 2)}{'1' * (len(a) // 2)}'" for k, a in ALPHABETS.items()})
    classes = by_code({k: "array(" + ", ".join(f"array({a}, {n})" for a, n in c) + ")" for k, c in CLASSES.items()})
    spelt = f"""transform({named}, c -> named_struct('start', c.start, 'end', c.end, 'code', c.code, 'alphabet', {alphabet}, 'halves', {halves}, 'classes', {classes}, 'value',
        CASE c.code WHEN 'hex' THEN lower(c.value) WHEN 'base32' THEN c.value ELSE translate(c.value, '-_', '+/') END))"""
    digit = "CAST(locate(y, c.alphabet) - 1 AS DOUBLE)"
    # products of neighbours, the last with the first: a piece and the character after it at a time
    piece = f"split(substring(concat(c.value, left(c.value, 1)), at + 1, {PIECE + 1}), '(?!^)')"
    products = f"""aggregate(sequence(0, length(c.value) - 1, {PIECE}), 0D, (total, at) -> total + aggregate({piece}, named_struct('last', 0D, 'sum', 0D),
        (s, y) -> named_struct('last', {digit}, 'sum', s.sum + s.last * {digit}), s -> s.sum))"""
    counted = f"""transform({spelt}, c -> named_struct('start', c.start, 'end', c.end, 'code', c.code, 'classes', c.classes, 'k', CAST(length(c.alphabet) AS DOUBLE), 'n', CAST(length(c.value) AS DOUBLE),
        'counts', transform(split(c.alphabet, '(?!^)'), y -> CAST(length(c.value) - length(replace(c.value, y, '')) AS DOUBLE)), 'half', translate(c.value, c.alphabet, c.halves), 'products', {products}))"""
    total = lambda array, f: f"aggregate({array}, 0D, (s, y) -> s + {f})"
    weighted = lambda f: f"aggregate(transform(c.counts, (y, i) -> y * {f}), 0D, (s, y) -> s + y)"
    in_class = total("slice(c.counts, g[0] + 1, g[1])", "y")
    sums = f"""transform({counted}, c -> named_struct('start', c.start, 'end', c.end, 'code', c.code, 'k', c.k, 'n', c.n, 'groups', CAST(size(c.classes) - 1 AS DOUBLE),
        'chi', {total("c.counts", "y * y")} * c.k / c.n - c.n, 'class_chi', aggregate(c.classes, 0D, (z, g) -> z + pow({in_class}, 2) * c.k / (c.n * g[1])) - c.n,
        'ones', CAST(length(c.half) - length(replace(c.half, '1', '')) AS DOUBLE), 'runs', 1 + (2 * length(c.half) - length(replace(c.half, '01', '')) - length(replace(c.half, '10', ''))) / 2D,
        'sum', {weighted("i")}, 'squares', {weighted("i * i")}, 'products', c.products))"""
    # Wilson-Hilferty for chi-squared; Wald-Wolfowitz for runs; Knuth for serial correlation
    mean = "(2 * c.ones * (c.n - c.ones) / c.n + 1)"
    runs = f"abs(c.runs - {mean}) / sqrt(greatest(({mean} - 1) * ({mean} - 2) / (c.n - 1), 1e-9D))"
    spread = "(c.n * c.squares - c.sum * c.sum)"
    serial = f"abs((c.n * c.products - c.sum * c.sum) / {spread} + 1 / (c.n - 1)) / sqrt(c.n * (c.n - 3) / ((c.n - 1) * (c.n - 1) * (c.n + 1)))"
    scores = f"""transform({sums}, c -> named_struct('start', c.start, 'end', c.end, 'code', c.code, 'n', c.n, 'chi', {_chi_tail("c.chi", "(c.k - 1)")}, 'class', {_chi_tail("c.class_chi", "c.groups")},
        'runs', CASE WHEN c.ones = 0 OR c.ones = c.n THEN 40D ELSE {runs} END, 'serial', CASE WHEN {spread} <= 0 THEN 40D ELSE {serial} END))"""
    least = f"least(c.chi, c.class, {_tail('c.runs')}, {_tail('c.serial')})"
    return F.expr(f"transform({scores}, c -> named_struct('start', c.start, 'end', c.end, 'code', c.code, 'n', CAST(c.n AS BIGINT), 'p', least(1D, greatest(1e-{DECADES}D, 4 * {least}))))")


Binned = list[tuple[str, int, int, int]]


def _by_stratum(rows: Binned) -> dict:
    by = defaultdict(lambda: defaultdict(int))
    for code, doubling, b, n in rows:
        by[code, doubling][b] += n
    return by


def cuts(tokens: Binned, plain: Binned, rate: float = RATE, missed: float = MISSED) -> dict[tuple[str, int], int]:
    """Benjamini-Hochberg on bins. Both: code, doubling, bin (larger: smaller p), count; of
    the tokens and of the ordinary strings. Returns the last bin of each stratum whose
    tokens are reported; a stratum without one is left out."""
    found, ordinary_by = {}, _by_stratum(plain)
    for stratum, bins in _by_stratum(tokens).items():
        null = ordinary_by[stratum]
        total, so_far, under = sum(bins.values()), 0, 0
        for b in range(BINS * DECADES + 1):
            so_far, under = so_far + bins.get(b, 0), under + null.get(b, 0)
            share = (1 + under) / (1 + sum(null.values()))
            if 10 ** (-b / BINS) >= missed and total * share <= rate * so_far:
                found[stratum] = b
    return found


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", rate: float = RATE) -> DataFrame:
    """key, n_assign, n_access, n_hex, base_sha256, n_random, spans for every row."""
    rows = docs.select(F.col(key), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    rows = rows.select(key, "t", blanked("t", ASSIGN, 2, MIN_VALUE).alias("rest"))
    kind = lambda name, c: F.transform(c, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(name)).alias("kind"), s["end"].alias("end")))
    base = {"assign": F.filter(located("t", ASSIGN, 2), lambda s: F.length(s["value"]) >= MIN_VALUE), "access": located("t", ACCESS), "hex": located("t", HEX)}
    rows = rows.select(
        key,
        F.array_sort(F.concat(*[kind(k, c) for k, c in base.items()])).alias("base"),
        F.filter(located("rest", TOKEN), lambda s: ~s["value"].rlike(HELD)).alias("tokens"),
        ordinary("t").alias("plain"),
    )
    held = materialize(rows.select(key, "base", tested("tokens").alias("tokens"), tested("plain").alias("plain")), "secrets")
    stratum = lambda c: (
        c["code"],
        F.least(F.floor(F.log2(c["n"].cast("double"))), F.lit(max(ORDINARY).bit_length() - 1)).cast("int"),
        F.floor(-F.log10(c["p"]) * BINS).cast("int"),
    )

    def histogram(column: str) -> Binned:
        each = held.where(F.size(column) > 0).select(F.explode(column).alias("c"))
        binned = each.select(*[x.alias(n) for x, n in zip(stratum(F.col("c")), ("code", "doubling", "bin"), strict=True)])
        return [tuple(r) for r in binned.groupBy("code", "doubling", "bin").count().collect()]

    found = cuts(histogram("tokens"), histogram("plain"), rate)

    def random(c: Column) -> Column:
        code, doubling, b = stratum(c)
        kept = F.lit(False)
        for (own, size), cut in sorted(found.items()):
            kept = kept | ((code == own) & (doubling == size) & (b <= cut))
        return kept

    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"], s["end"])), ",")
    count = lambda name: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(name))).cast("long").alias(f"n_{name}")
    held = held.withColumn("more", kind("random", F.filter("tokens", random)))
    return held.select(
        key,
        *[count(k) for k in KINDS[:3]],
        F.sha2(listed("base"), 256).alias("base_sha256"),
        F.size("more").cast("long").alias("n_random"),
        listed(F.array_sort(F.concat("base", "more"))).alias("spans"),
    )
