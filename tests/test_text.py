"""Text and name functions on literal rows."""

import pytest
from pyspark.sql import functions as F

from docketry.functions import names
from docketry.functions import text as T
from docketry.functions.citations import balanced, citations, recognise, that_parenthetical


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first()["x"]


def of(spark, f, value):
    return one(spark, f(F.col("v")), v=value)


@pytest.mark.parametrize(
    ("f", "value", "want"),
    [
        (T.strip, " \t a b\n", "a b"),
        (T.collapse, " a \n\t b ", "a b"),
        (T.recogniser_text, "a—b__c\n d", "a -- bc d"),
        (T.join_hyphens, "well- known com-\nplete", "wellknown complete"),
        (T.join_line_hyphens, "com-\nplete well- known", "complete well- known"),
        (T.matching_text, "“The  [lower] court”—held.....so", '"the court"-held ... so'),
        (T.unpunctuated, "a, b. (c)", "a b c"),
        (T.html_text, "<p>a &amp;&nbsp;b</p>\n<b>c</b>&quot;", 'a & b c "'),
        (T.html_escape, "<a & 'b'>", "&lt;a &amp; &#x27;b&#x27;&gt;"),
        (T.zero_filled, "7", "0007"),
        (T.zero_filled, "12345", "12345"),
        (lambda c: T.preview(c, 3), "abcd", "abc..."),
        (lambda c: T.preview(c, 4), "abcd", "abcd"),
        (T.signal_before, "This is so. But See ", "but see"),
        (T.signal_before, "They oversee", "see"),
        (T.signal_before, "nothing", None),
        (T.signal_at_end, "It is. See, e.g., ", "see, e.g.,"),
        (T.signal_at_end, "They oversee", None),
        (T.without_signal, "It is so. See also ", "It is so."),
        (T.without_annotation, "(emphasis added). The rule", "The rule"),
        (T.without_leading_citations, "Id. at 91–92; Brown, 50 S.W.3d at 100; and the rule holds", "the rule holds"),
        (T.without_leading_citations, "Brown, supra, at 100; X", "X"),
        (T.without_leading_citations, "see also", ""),
        (T.is_string_cite, "; and ", True),
        (T.is_string_cite, "; the rule", False),
        (names.compared_name, "Roderick Beham v. State", "Beham v. State"),
        (names.compared_name, "Debra Dando v. Joan Yukins, Warden", "Dando v. Yukins"),
        (names.compared_name, "United States v. Lee", "United States v. Lee"),
        (names.compared_name, "In re Smith", "In re Smith"),
        (names.compared_name, None, ""),
        (names.pin_page, "at 685", 685),
        (names.opinion_id, "https://x.test/opinions/77/", "77"),
        (names.reporter_slug, "S.W.3d", "sw3d"),
        (names.reporter_slug, "X.Y.", None),
        (T.is_abbreviation, "Inc.", True),
        (T.is_abbreviation, "3d.", True),
        (T.is_abbreviation, "court.", False),
    ],
)
def test_scalars(spark, f, value, want):
    assert one(spark, f(F.lit(value).cast("string"))) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("The court held. It was so.", ["The court held.", "It was so."]),
        ("See Doe v. State, 5 U.S. 7. Then it ended.", ["See Doe v. State, 5 U.S. 7.", "Then it ended."]),
        ("Smith Inc. Was there. Dr. Who? Yes!", ["Smith Inc. Was there.", "Dr. Who?", "Yes!"]),
        ("It said. “So it is.” Done.", ["It said.", "“So it is.", "” Done."]),
        ("In the U. S. Court.", ["In the U. S. Court."]),
        ("no capitals. here", ["no capitals. here"]),
        ("", []),
    ],
)
def test_sentences(spark, text, want):
    assert of(spark, T.sentences, text) == want


def test_quotations(spark):
    text = 'a "one two" b “three” c'
    assert of(spark, T.quotations, text) == ["one two", "three"]
    spans = of(spark, T.quoted_spans, text)
    assert [text[s["start"] : s["end"]] for s in spans] == ['"one two"', "“three”"]
    assert of(spark, T.has_quotation, '"fifteen letters and more"') and not of(spark, T.has_quotation, '"short"')
    assert one(spark, T.is_quote(F.lit('x "' + "y" * 40 + '"'), F.lit("statement")))
    assert one(spark, T.is_quote(F.lit("x"), F.lit("block_quote")))


def test_chunks_and_terms(spark):
    text = "This is the first sentence of the text and it goes on. Next one."
    assert of(spark, T.search_chunks, text) == ["This is the first sentence of the text and it", "Next one."]
    assert of(spark, T.search_chunks, "short") == ["short"] and of(spark, T.search_chunks, " ") == []
    assert of(spark, T.search_terms, "Id. at 100") == ["Id. at 100"]
    assert of(spark, T.search_terms, "Doe v. State of Texas, 50 S.W.3d 285 (Tex. 2001)") == ["50 S.W.3d 285", "Doe v. State of Texas, 50"]


def test_party_names(spark):
    name = lambda p, d: one(spark, names.party_name(F.lit(p), F.lit(d).cast("string")))
    assert name("Rodgriguez [sic]", "40 State, et al.") == "Rodgriguez v. State"
    assert name("Doe;", None) == "Doe" and name("[sic]", "X") is None
    assert one(spark, names.dashed_name(F.lit("text -- Doe"), F.lit(""))) == "Doe v. "


def test_pages_and_paths(spark):
    cites = F.array(F.lit("x y z"), F.lit("184 S.W.3d 242"), F.lit("50 S.W. 9"))
    assert one(spark, names.first_page(cites)) == 242
    assert one(spark, names.first_page_in(cites, F.lit("S.W."))) == "9"
    assert one(spark, names.volume_and_reporter(F.array(F.lit("12 F. Supp. 2d 7")))).asDict() == {"volume": "12", "reporter": "F. Supp. 2d"}
    assert one(spark, names.case_path("base", F.lit("50"), F.lit("S.W.3d"), F.lit("285"), "json")) == "base/sw3d/50/json/0285-01.json"
    pin = lambda p, s: one(spark, names.plausible_pin(F.lit(p).cast("string"), F.lit(s).cast("int")))
    assert pin("at 260", 242) and not pin("at 300", 242) and pin(None, 242) and pin("x", None)


def test_recogniser():
    text = "See Doe v. State, 50 S.W.3d 285, 290 (Tex. 2001) (holding that (so) it is). Id. at 7. Doe, 50 S.W.3d at 291; Smith, supra, at 12."
    found = recognise(text)
    assert [c["cite_type"] for c in found] == ["full_case", "id", "short_case", "supra"]
    full = found[0]
    assert (full["volume"], full["reporter"], full["page"], full["pin_cite"]) == ("50", "S.W.3d", "285", "290")
    assert (full["plaintiff"], full["defendant"], full["parenthetical"]) == ("See Doe", "State", "holding that (so) it is") or full["plaintiff"] == "Doe"
    assert all(text[c["start"] : c["end"]] == c["text"] for c in found)
    assert found[2]["antecedent"] == "Doe" and found[3]["pin_cite"] == "12" and found[1]["pin_cite"] == "7"
    assert recognise(None) == [] and recognise("no citation v. here") == []
    assert balanced(" (noting (a) b", 0) == (None, 0)


def test_recogniser_columns(spark):
    assert [c["reporter"] for c in of(spark, citations, "1 F. Supp. 2d 3; 5 U.S. 7")] == ["F. Supp. 2d", "U.S."]
    assert one(spark, that_parenthetical(F.lit("X (holding that y is z) w"), F.lit(1))) == "y is z"
    assert one(spark, that_parenthetical(F.lit("X, 1 U.S. 2 (holding that y)"), F.lit(1))) is None


def test_offsets_count_what_separates_sentences(spark):
    """Boundaries before quotation marks have no space; a long text takes several levels of sums."""
    text = 'He said "go." Then he left. "Stay." She stayed. Next came X.'
    assert of(spark, T.boundaries, text) == [48]
    rng = __import__("random").Random(3)
    words = ["so it goes", "It went", "the end", '"Well"', "Now", "x v. Y", "No. 5"]
    for n in (3, 40, 700):
        made = "".join(rng.choice(words) + rng.choice([". ", ".", "! ", "?  ", " ", ", "]) for _ in range(n))
        plain, at = [], 0
        while at < len(made):
            if made[at] in ".!?" and not (made[:at].endswith(" v") or made[:at].endswith("No") and (at < 3 or not made[at - 3].isalnum())):
                rest = made[at + 1 :].lstrip()
                if rest and rest[0].isupper():
                    plain.append(len(made) - len(rest))
            at += 1
        assert of(spark, T.boundaries, made) == plain
    spans = of(spark, T.quoted_spans, 'a "b c" d “e” ' * 200)
    assert len(spans) == 400 and spans[-1]["end"] == 200 * 14 - 1 and spans[2]["start"] == 16


def test_units_before_an_offset(spark):
    text = "A b. C d. See E v. F, 1 U.S. 2. G said. 50 U.S. at 3"
    start = lambda end, **options: spark.range(1).select(T.unit_start(F.lit(text), F.lit(end), **options)).first()[0]
    assert start(14) == 5  # "See" belongs to what follows "C d."
    assert start(text.index("50")) == text.index("G")  # closed right before the citation, whatever follows
    assert start(10) == 5 and start(3) == 0
    assert start(len(text) - 1, back=1) == text.index("G") and start(len(text) - 1, back=1, window=4) == len(text) - 5


def test_annotations(spark):
    for lead in ("(cleaned up).", "(internal marks omitted)", "(emphasis mine).", "(footnote 3)", "(quotation marks altered)"):
        assert of(spark, T.without_annotation, f"{lead} The rule") == "The rule"
    assert of(spark, T.without_annotation, "(a plain remark) The rule") == "(a plain remark) The rule"


def test_names_before_citations():
    got = lambda t: [(x["text"], x["plaintiff"], x["defendant"], x["antecedent"]) for x in recognise(t)]
    assert got("See Doe v. State, 1 U.S. 2") == [("Doe v. State, 1 U.S. 2", "Doe", "State", None)]
    assert got("(Smith of the North, Inc. v. Jones & Co., 5 U.S. 7)") == [("Smith of the North, Inc. v. Jones & Co., 5 U.S. 7", "Smith of the North, Inc.", "Jones & Co.", None)]
    assert got("It was Held. Accord The State v. X, 1 U.S. 1") == [("The State v. X, 1 U.S. 1", "The State", "X", None)]
    assert got("In re Doe, 4 U.S. 5; See, 3 U.S. at 4; Brown, supra, at 4") == [("In re Doe, 4 U.S. 5", "In re Doe", None, None), ("3 U.S. at 4", None, None, None), ("Brown, supra, at 4", None, None, "Brown")]
    long = "Alpha Beta, " * 50_000
    assert recognise(long + "5 U.S. 7")[0]["plaintiff"] is None and recognise("1" * 100_000 + "A" * 100_000 + ", supra")[0]["cite_type"] == "supra"
