"""Operators on small literal tables, and whole briefs end to end."""

from pyspark.sql import functions as F

from docketry.operators import annotate, layout, propose, report, resolve, sections, verify
from docketry.plans import briefs
from docketry.sources import readers
from docketry.streaming import ingest

BLOCKS = readers.BLOCKS


def block(page, number, text, x0=72.0, brief="b"):
    return (brief, page, number, x0, 10.0 * number, x0 + 400, 10.0 * number + 9, text, 0)


def page_rows(spark, texts, brief="b"):
    return spark.createDataFrame([(brief, i + 1, t) for i, t in enumerate(texts)], "brief_id string, page_num int, text string")


def test_sections(spark):
    pages = page_rows(spark, ["Contents\nargument here", "intro", "  ARGUMENT \nfirst", "more\nConclusion\nend", "Prayer\nx"])
    got = sections.find_sections(pages, "Argument", ["Prayer", "Conclusion"]).first()
    assert (got["start_page"], got["end_page"], got["end_heading"]) == (3, 5, "Prayer")
    got = sections.find_sections(pages, "Argument", ["Nothing"]).first()
    assert (got["end_page"], got["end_heading"]) == (5, None)
    best = sections.first_section(pages, [("Reply Argument", ["Prayer"], False), ("Argument", ["Prayer"], False)]).first()
    assert best["choice"] == 1
    assert sections.find_sections(pages, "Missing", []).count() == 0
    text = sections.section_text(pages, best_frame(spark, 3, 4, "Argument", "Conclusion")).first()["text"]
    assert text.split() == ["first", "more"]
    assert pages.select(sections.cases_part(F.lit("Cases\nA v. B\nStatutes\nx")).alias("x")).first()["x"] == "A v. B\n"


def best_frame(spark, start, end, heading, last):
    return spark.createDataFrame([("b", start, end, heading, last)], "brief_id string, start_page int, end_page int, heading string, end_heading string")


def test_margins_and_runs(spark):
    long = "a text that is long enough to be counted here"
    rows = [block(1, i, long, x) for i, x in enumerate([72.4, 72.0, 108.0, 108.0, 108.2, 72.5, 200.0])]
    blocks = spark.createDataFrame(rows, BLOCKS)
    m = layout.margins(blocks).first()
    assert (m["body_margin"], m["para_indent"]) == (72.0, 108.0)
    own = layout.body_blocks(blocks, layout.margins(blocks), spark.createDataFrame([("b", 1, 1)], "brief_id string, start_page int, end_page int"))
    assert own.count() == 6
    runs = layout.quote_runs(own).collect()
    assert [(r["blocks"], r["start_page"]) for r in runs] == [(3, 1)]
    kinds = [(r["block_no"], r["para_idx"], r["kind"]) for r in layout.paragraph_ids(own).orderBy("block_no").collect()]
    assert kinds == [(0, 0, "body"), (1, 0, "body"), (2, 1, "block_quote"), (3, 1, "block_quote"), (4, 1, "block_quote"), (5, 2, "body")]
    single = layout.margins(blocks.where("block_no < 2")).first()
    assert single["para_indent"] == 108.0


def python_paragraphs(indents):
    """Plain loop: runs of two or more hot blocks are quotations; a lone hot one opens a
    paragraph if the next block outside (10, 25] is hot."""
    hot = [i > 25 for i in indents]
    quote = [h and ((n > 0 and hot[n - 1]) or (n + 1 < len(hot) and hot[n + 1])) for n, h in enumerate(hot)]
    out, number = [], -1
    for n in range(len(hot)):
        later = next((hot[k] for k in range(n + 1, len(hot)) if not 10 < indents[k] <= 25), False)
        if n == 0 or quote[n] != quote[n - 1] or (hot[n] and not quote[n] and later):
            number += 1
        out.append((number, "block_quote" if quote[n] else "body"))
    return out


def test_paragraphs_match_a_loop(spark):
    import random

    rng, rows, want = random.Random(4), [], {}
    for b in range(60):
        indents = [rng.choice([0, 5, 20, 40]) for _ in range(rng.randint(1, 15))]
        rows += [block(1, n, "t", 72.0 + i, f"b{b}") for n, i in enumerate(indents)]
        want[f"b{b}"] = python_paragraphs(indents)
    blocks = spark.createDataFrame(rows, BLOCKS).withColumn("body_margin", F.lit(72.0))
    got = {}
    for r in layout.paragraph_ids(blocks).orderBy("brief_id", "block_no").collect():
        got.setdefault(r["brief_id"], []).append((r["para_idx"], r["kind"]))
    assert got == want


def cites(spark, rows):
    return spark.createDataFrame([("b", i + 1, *r) for i, r in enumerate(rows)], "brief_id string, seq int, cite_type string, volume string, reporter string, page string, pin_cite string, case_name string")


def test_resolution(spark):
    frame = cites(
        spark,
        [
            ("full_case", "1", "U.S.", "100", "105", "A"),
            ("short_case", "1", "U.S.", None, "107", None),
            ("id", None, None, None, "119", None),
            ("full_case", "2", "U.S.", "50", None, "B"),  # no record
            ("id", None, None, None, None, None),
            ("short_case", "2", "U.S.", None, None, None),
            ("supra", None, None, None, None, None),
            ("id", None, None, None, "900", None),
        ],
    )
    records = spark.createDataFrame([("1", "U.S.", "100", "rec A", 100)], "volume string, reporter string, page string, record string, start_page int")
    got = {r["seq"]: r for r in resolve.resolve(frame, records).collect()}
    assert [got[i]["record"] for i in range(1, 9)] == ["rec A", "rec A", "rec A", None, "rec A", None, "rec A", "rec A"]
    assert got[5]["ambiguous"] and not got[3]["ambiguous"]
    assert got[5]["refers_to"] == "B" and got[3]["refers_to"] == "A"
    assert got[5]["pin_cite"] == "119"
    assert resolve.keys_of(frame).count() == 2
    for r in got.values():
        assert r["record"] is None or r["seq"] >= 1


def test_second_pass_checks_pages(spark):
    frame = cites(spark, [("full_case", "1", "U.S.", "100", None, "A"), ("short_case", "1", "U.S.", "99", None, None), ("short_case", "1", "U.S.", "x", None, None), ("short_case", "1", "U.S.", "101", None, None), ("id", None, None, None, "121", None)])
    frame = frame.withColumns({"record": F.when(F.col("seq") == 1, "rec"), "start_page": F.when(F.col("seq") == 1, 100)})
    got = {r["seq"]: r["record"] for r in resolve.propagate_short(frame).collect()}
    assert got == {1: "rec", 2: None, 3: None, 4: "rec", 5: None}
    last = {r["seq"]: r["record"] for r in resolve.propagate_id(frame.where("seq in (1, 5)")).collect()}
    assert last[5] is None
    assert {r["seq"]: r["record"] for r in resolve.propagate_id(frame.where("seq in (1, 5)"), limit=30).collect()}[5] == "rec"


def test_string_groups_and_starts(spark):
    frame = spark.createDataFrame([("b", 1, False, "p1", 0, 10, None, 0), ("b", 2, True, "", 12, 20, 30, 5), ("b", 3, False, "p3", 40, 50, None, 35)], "brief_id string, seq int, is_string_cite boolean, proposition string, start int, end int, paren_end int, sentence_start int")
    got = resolve.string_groups(frame).orderBy("seq").collect()
    assert [(r["string_cite_group"], r["proposition"]) for r in got] == [(1, "p1"), (1, "p1"), (2, "p3")]
    assert [r["actual_start"] for r in resolve.preceding_start(frame).orderBy("seq").collect()] == [0, 10, 35]


def unit_rows(spark, rows):
    return spark.createDataFrame([("b", i, *r) for i, r in enumerate(rows)], "brief_id string, unit_seq int, kind string, text string, intro string")


def test_propositions(spark):
    units = unit_rows(spark, [("body", "The first unit says a good deal.", None), ("body", "See Doe, 1 U.S. 2.", None), ("body", "A rule of twenty letters or more, see Doe, 1 U.S. 2.", None), ("body", "The rule -- Doe, 1 U.S. 2 -- holds.", None), ("block_quote", "Quoted at length. 1 U.S. 2", "As they said:")])
    text = [r["text"] for r in units.orderBy("unit_seq").collect()]
    rows = [("b", n, n, text[n].index("Doe") if "Doe" in text[n] else 18, text[n].index("1 U.S. 2") + 8, "see" if n == 2 else None, "holding so" if n == 2 else None, "c") for n in range(1, 5)]
    found = propose.propositions(units, spark.createDataFrame(rows, "brief_id string, unit_seq int, seq int, start int, end int, signal string, parenthetical string, text string")).orderBy("prop_seq").collect()
    assert [(r["text"], r["type"]) for r in found] == [
        ("The first unit says a good deal.", "statement"), ("holding so", "parenthetical"), ("A rule of twenty letters or more", "statement"), ("The rule holds.", "statement"), ("Quoted at length. 1 U.S. 2", "block_quote"),
    ]
    assert found[-1]["intro"] == "As they said:"


def test_intros(spark):
    got = propose.attach_intros(unit_rows(spark, [("body", "x.", None), ("body", "They said:", None), ("block_quote", "q", None)])).orderBy("unit_seq").collect()
    assert [(r["text"], r["intro"], r["intro_seq"]) for r in got] == [("x.", None, None), ("q", "They said:", 1)]


def test_consolidate(spark):
    head = "z" * 200
    props = spark.createDataFrame([("b", 0, head + "1", "quote", ["a"]), ("b", 1, head + "2", "statement", ["b", "c"]), ("b", 2, "short", "statement", ["d"])], "brief_id string, prop_seq int, text string, type string, citations array<string>")
    got = propose.consolidate(props).collect()
    assert [(r["type"], r["citations"]) for r in got] == [("quote", ["a", "b", "c"])]


def test_block_quote_links(spark):
    items = spark.createDataFrame([("b", 0, "They wrote: one two three four five six seven eight nine ten eleven"), ("b", 1, "other")], "brief_id string, item_seq int, preceding_text string")
    quotes = spark.createDataFrame([("b", 3, "one two three four five six seven eight nine ten eleven twelve"), ("b", 2, "one two three four five six seven eight nine ten other")], "brief_id string, bq_idx int, text string")
    got = {r["item_seq"]: (r["bq_idx"], r["intro"]) for r in propose.link_block_quotes(items, quotes).collect()}
    assert got == {0: (2, "They wrote:"), 1: (None, None)}


def test_verify_anywhere_equals_all_pairs(spark, sf):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    more = items.unionByName(docs.where("doc_id < 20").selectExpr("1000 + doc_id AS item_id", "substring(text, 7, 50) AS text")).unionByName(spark.createDataFrame([(2000, "the"), (2001, ""), (2002, None)], "item_id long, text string"))
    got = {tuple(r) for r in verify.verify_anywhere(more, docs, "item_id", "text", "doc_id", "text").collect()}
    from docketry.functions.text import matching_text

    q = [tuple(r) for r in more.select("item_id", matching_text(F.col("text"), False)).collect()]
    t = [tuple(r) for r in docs.select("doc_id", matching_text(F.col("text"), False)).collect()]
    assert got == {(i, d) for i, x in q for d, y in t if x and y is not None and x in y}


def test_case_text_and_pages(spark, tmp_path):
    html = '<a id="p12" href="#">*12</a> Page <b>twelve</b> text <a id="p13">*13</a> thirteen'
    (tmp_path / "cases/sw3d/5/html").mkdir(parents=True)
    (tmp_path / "cases/sw3d/5/json").mkdir(parents=True)
    (tmp_path / "cases/sw3d/5/html/0012-01.html").write_text(html)
    (tmp_path / "cases/sw3d/5/json/0012-01.json").write_text('{"id": 1,\n "casebody": {"opinions": [{"text": ""}, {"text": null}]}}')
    (tmp_path / "cases/sw3d/5/json/0013-01.json").write_text('{"id": 2, "casebody": {"opinions": [{"text": "a"}, {"text": "b"}]}}')
    pages = readers.read_case_pages(spark, str(tmp_path / "cases"))
    assert [(r["page"], r["text"]) for r in verify.case_pages(pages.withColumnRenamed("value", "value")).orderBy("page").collect()] == [(12, "*12 Page twelve text"), (13, "*13 thirteen")]
    texts = {r["path"].rsplit("/", 1)[1]: r["text"] for r in verify.case_text(readers.read_cases(spark, str(tmp_path / "cases")), pages).collect()}
    assert texts == {"0012-01.json": "*12 Page twelve text *13 thirteen", "0013-01.json": "a\n\nb"}
    assert readers.existing_files(spark, str(tmp_path / "cases")).count() == 3


def test_validation(spark):
    schema = "brief_id string, prop_seq int, text string, type string, citations array<struct<text:string,pin_cite:string,local_json_path:string>>"
    good = [("c", "at 12", "p1")]
    props = spark.createDataFrame(
        [("b", 0, "none", "statement", []), ("b", 1, "x", "statement", [("c", None, None)]), ("b", 2, "lost", "statement", [("c", None, "p9")]),
         ("b", 3, 'It said "the court below erred in its ruling"', "quote", good), ("b", 4, "entirely unrelated propositions", "statement", good), ("b", 5, "court below erred ruling", "statement", good)], schema,
    )
    cases = spark.createDataFrame([("p1", "We hold that the  court below erred in its ruling, and so on.")], "path string, text string")
    pages = spark.createDataFrame([("p1", 11, "other")], "path string, page int, text string")
    got = {r["prop_seq"]: r for r in verify.validate(props, cases, pages).collect()}
    assert {k: r["result"] for k, r in got.items()} == {0: "uncertain", 1: "uncertain", 2: "uncertain", 3: "verified", 4: "uncertain", 5: "uncertain"}
    assert got[0]["explanation"] == "no citations" and got[3]["explanation"] == "quotation found"
    summary = report.validation_summary(verify.validate(props, cases, pages)).first()
    assert summary["verified"] + summary["failed"] + summary["uncertain"] == summary["total"] == 6
    html = report.html_report(verify.validate(props, cases, pages)).first()["html"]
    assert "verified 1" in html and "&quot;the court below" in html


def test_verdicts(spark):
    rows = spark.createDataFrame([("VERIFIED: yes",), ("NOT VERIFIED",), ("unverified",), ("**Failed**\nVERIFIED",), (None,)], "r string")
    assert [r[0] for r in rows.select(verify.verdict_of(F.col("r"))).collect()] == ["verified", "failed", "failed", "failed", "uncertain"]


def test_authorities(spark):
    listed = spark.createDataFrame([("b", "Ann Doe v. State"), ("c", "X v. Y")], "brief_id string, case_name string")
    argued = spark.createDataFrame([("b", "Doe v. State")], "brief_id string, case_name string")
    got = {r["brief_id"]: r for r in report.compare_authorities(listed, argued).collect()}
    assert got["b"]["cases_match"] and got["b"]["only_toa"] == ["Ann Doe v. State"]
    assert not got["c"]["cases_match"] and got["c"]["argument_case_count"] == 0


def test_annotations(spark):
    blocks = spark.createDataFrame([block(1, 0, "before it all"), block(2, 1, "see 50 S.W.3d 285 here"), block(3, 2, "50 S.W.3d 285")], BLOCKS)
    cites_ = spark.createDataFrame([("b", 1, "Doe v. State of the Union of it all, 50 S.W.3d 285"), ("b", 2, "nowhere")], "brief_id string, seq int, text string")
    got = annotate.locate_citations(blocks, cites_).collect()
    assert [(r["seq"], r["page_num"], len(r["rects"])) for r in got] == [(1, 2, 1)]
    words = readers.words_of(blocks)
    assert words.where("page_num = 1").count() == 3
    line = spark.createDataFrame([("b", 1, 10.0 * i, 0.0, 10.0 * i + 9, 8.0, w, 0, 0, i) for i, w in enumerate("It ended. The rule holds".split())], readers.WORDS)
    place = spark.createDataFrame([("b", 7, 1, 200.0, 1.0)], "brief_id string, seq int, page_num int, cx double, cy double")
    assert [r["word"] for r in annotate.preceding_words(line, place).orderBy("word_no").collect()] == ["The", "rule", "holds"]
    rects = spark.createDataFrame([("b", 1, 0.0, 5.0, 9.0, "citation", True)], "brief_id string, page_num int, x0 double, x1 double, y1 double, kind string, signalled boolean")
    assert sorted(r["y"] for r in annotate.underlines(rects).collect()) == [10.0, 13.0]
    texts = spark.createDataFrame([("b", 0, "before it all", 1, 3)], "brief_id string, text_id int, text string, start_page int, end_page int")
    assert annotate.locate_chunks(blocks, texts).first()["page_num"] == 1


BRIEF = [
    block(1, 0, "Index of Authorities"), block(2, 1, "ARGUMENT"),
    block(2, 2, "The standard of review is settled and long known. Doe v. State, 50 S.W.3d 285, 290 (Tex. 2001)."),
    block(2, 3, "Courts follow it without any exception at all. Id. at 291. The court in Doe wrote:"),
    block(2, 4, "a quotation that is set apart from the text", 120.0), block(2, 5, "and runs on for two lines. 60 S.W.3d 10", 120.0),
    block(3, 6, "It is so. Doe, 50 S.W.3d at 292."), block(3, 7, "PRAYER"), block(3, 8, "We pray. 9 U.S. 9"),
]


def test_briefs_end_to_end(spark):
    blocks = spark.createDataFrame([*BRIEF, block(1, 0, "nothing of the kind", brief="empty")], BLOCKS)
    records = spark.createDataFrame([("50", "S.W.3d", "285", ("Doe v. State", 7), 285)], "volume string, reporter string, page string, record struct<case_name:string,cluster_id:long>, start_page int")
    parsed = briefs.parse(blocks, records)
    assert {r["brief_id"]: r["status"] for r in parsed.status.collect()} == {"b": "ok", "empty": "no_section"}
    found = parsed.citations.orderBy("seq").collect()
    assert [(c["cite_type"], c["record"] is not None) for c in found] == [("full_case", True), ("id", True), ("full_case", False), ("short_case", True)]
    props = parsed.propositions.orderBy("prop_seq").collect()
    assert props[0]["text"] == "The standard of review is settled and long known."
    quote = next(p for p in props if p["type"] == "block_quote")
    assert quote["intro"] == "The court in Doe wrote:"
    cases = spark.createDataFrame([("cases/sw3d/50/json/0285-01.json", "The standard of review is settled and long known.")], "path string, text string")
    verdicts = briefs.validate(parsed, cases, spark.createDataFrame([], "path string, page int, text string"))
    assert verdicts.count() == len(props) and "verified" in {r["result"] for r in verdicts.collect()}
    assert briefs.report_of(verdicts).count() == 1


def test_items(spark):
    pages = page_rows(spark, ["Argument\nThe rule is an old one. See Doe v. State, 50 S.W.3d 285 (Tex. 2001) (holding that it is); 60 S.W.3d 10. It \"goes on\" further. Id. at 7.\nPrayer\nx"])
    got = briefs.items(pages).orderBy("seq").collect()
    assert [g["cite_type"] for g in got] == ["full_case", "full_case", "id"]
    assert [g["is_string_cite"] for g in got] == [False, True, False] and [g["string_cite_group"] for g in got] == [1, 1, 2]
    assert got[2]["has_quotation"] and got[2]["content_type"] == "quotation"


def test_registry_rows(spark):
    rows = spark.createDataFrame([(1, "a", 1, False), (1, "b", 2, None), (2, "c", 1, False), (2, "c", 3, True)], "id int, v string, version long, deleted boolean")
    assert [(r["id"], r["v"]) for r in readers.latest(rows, "id", "version").collect()] == [(1, "b")]


def test_user_briefs(spark):
    users = spark.createDataFrame([(1, "a@x"), (2, "b@x")], "user_id int, email string")
    own = spark.createDataFrame([(10, 1, "f", None, None), (11, 2, "g", None, None)], "brief_id int, user_id int, filename string, uploaded_at timestamp, processed_at timestamp")
    assert [(r["brief_id"], r["processed"]) for r in report.user_briefs(users, own, F.lit("a@x")).collect()] == [(10, False)]


def decode_lines(content):
    for n, line in enumerate(content.decode().splitlines()):
        yield {"page_num": 1, "block_no": n, "x0": 72.0, "y0": 10.0 * n, "x1": 400.0, "y1": 10.0 * n + 9, "text": line, "block_type": 0}


def test_streaming_ingest(spark, tmp_path):
    inbox, out = tmp_path / "in", tmp_path / "out"
    inbox.mkdir()
    (inbox / "a.pdf").write_text("one\ntwo")
    (inbox / "skip.txt").write_text("x")
    run = lambda: ingest.ingest(ingest.brief_stream(spark, str(inbox)), decode_lines, str(out), str(tmp_path / "state")).awaitTermination()
    run()
    (inbox / "b.pdf").write_text("three")
    run()
    assert sorted(r["text"] for r in spark.read.parquet(str(out)).collect()) == ["one", "three", "two"]
    assert readers.decoded(readers.binary_files(spark, str(inbox)), decode_lines).count() == 3


def test_assembled_cases(spark):
    records = spark.createDataFrame([(1, "A"), (2, "B")], "cluster_id long, name string")
    opinions = spark.createDataFrame([(1, 2, "dissent", None, "J", "<p>no</p>"), (1, 1, "lead", "yes", "K", None)], "cluster_id long, seq int, type string, text string, author string, html string")
    got = {r["name"]: r["casebody"] for r in readers.assemble_cases(records, opinions).collect()}
    assert [(o["type"], o["text"]) for o in got["A"]["opinions"]] == [("lead", "yes"), ("dissent", "no")] and got["B"]["opinions"] is None


def answer(volume, reporter, page):
    return None if page == "2" else f'{{"caseName": "A v. B", "citation": ["9 X. 1", "{volume} {reporter} {page}"], "cluster_id": 5}}'


def test_prefetch_keeps_misses(spark):
    from docketry.sources import lookup

    frame = cites(spark, [("full_case", "1", "U.S.", "1", None, None), ("full_case", "1", "U.S.", "1", None, None), ("full_case", "1", "U.S.", "2", None, None), ("id", None, None, None, None, None)])
    first = lookup.prefetch(frame, None, answer)
    assert sorted((r["page"], r["found"]) for r in first.collect()) == [("1", True), ("2", False)]
    assert lookup.prefetch(frame, first, answer).count() == 0
    got = lookup.records_of(first).collect()
    assert [(r["record"]["case_name"], r["start_page"]) for r in got] == [("A v. B", 1)]
    clusters = spark.createDataFrame([(5, ["https://x.test/o/7/", "https://x.test/o/8"])], "cluster_id long, urls array<string>")
    assert sorted((r["seq"], r["body"]) for r in lookup.opinions_of(clusters, lambda i: f"body {i}").collect()) == [(0, "body 7"), (1, "body 8")]


def test_annotated_files(spark):
    files = spark.createDataFrame([("b", bytearray(b"x")), ("c", bytearray(b"y"))], "brief_id string, content binary")
    rects = spark.createDataFrame([("b", 2, 0.0, 5.0, 9.0, "citation", True), ("b", 9, 0.0, 5.0, 9.0, "citation", False)], "brief_id string, page_num int, x0 double, x1 double, y1 double, kind string, signalled boolean")
    got = {r["brief_id"]: bytes(r["content"]) for r in annotate.write_annotated(files, annotate.underlines(rects), lambda c, own: bytes(c) + f"{len(own)}".encode(), (1, 3)).collect()}
    assert got == {"b": b"x2", "c": b"y0"}


def test_command_line(spark, tmp_path, capsys):
    from docketry import __main__ as cli

    assert cli.main(["list"]) == 0 and "pin_carry" in capsys.readouterr().out
    spark.createDataFrame(BRIEF, BLOCKS).write.parquet(str(tmp_path / "blocks"))
    spark.createDataFrame([("50", "S.W.3d", "285", ("Doe v. State", 7), 285)], "volume string, reporter string, page string, record struct<case_name:string,cluster_id:long>, start_page int").write.parquet(str(tmp_path / "records"))
    case = tmp_path / "cases/sw3d/50/json"
    case.mkdir(parents=True)
    (case / "0285-01.json").write_text('{"casebody": {"opinions": [{"text": "The standard of review is settled and long known."}]}}')
    assert cli.main(["validate", str(tmp_path / "blocks"), str(tmp_path / "records"), str(tmp_path / "cases"), str(tmp_path / "out")]) == 0
    found = spark.read.json(str(tmp_path / "out/validations"))
    assert found.count() > 2 and found.where("result = 'verified'").count() >= 1
    assert cli.main(["query", "nothing"]) == 2


def test_only_the_last_page_is_cut(spark):
    long = "word " * 2000
    html = spark.createDataFrame([("a", f'<a id="p1">*1</a> {long}first end <a id="p2">*2</a> {long}last end')], "path string, value string")
    texts = {r["page"]: r["text"] for r in verify.case_pages(html).collect()}
    assert texts[1].endswith("first end") and len(texts[2]) <= 5000


def test_only_whole_lines_are_headings(spark):
    pages = page_rows(spark, ["Argument\nfoo\nConclusion of law 5 was wrong.\nmore", "Argument goes on\nConclusion\nbye"])
    found = sections.first_section(pages, sections.ARGUMENT)
    assert sections.section_text(pages, found).first()["text"].split("\n") == ["", "foo", "Conclusion of law 5 was wrong.", "more", "Argument goes on", ""]
    by_prefix = sections.first_section(page_rows(spark, ["Argument of the state\nfoo\nConclusion"]), sections.ARGUMENT)
    assert sections.section_text(page_rows(spark, ["Argument of the state\nfoo\nConclusion"]), by_prefix).first()["text"].strip() == "foo"
    blocks = spark.createDataFrame([block(1, 1, "Argument"), block(1, 2, "Argument is long"), block(1, 3, "Conclusion of law"), block(2, 1, "text"), block(2, 2, "Conclusion"), block(2, 3, "no"), block(3, 1, "yes"), block(3, 2, "Prayer"), block(3, 3, "no")], BLOCKS)
    pages = sections.pages_of(blocks)
    found = sections.first_section(pages, sections.ARGUMENT)
    kept = layout.body_blocks(blocks, layout.margins(blocks), found, briefs.heading_positions(blocks, found))
    assert [r["text"] for r in kept.orderBy("page_num", "block_no").collect()] == ["Argument is long", "Conclusion of law", "text", "yes"]


def test_pages_across_a_gap_are_windows(spark):
    html = spark.createDataFrame([("a", f'<a id="p1">*1</a> one &eacute;&#8217; <a id="p2">*2</a> two {"w " * 50}<a id="p5">*5</a> five <a href="x">*6</a> six <a id="p5">*5</a> again')], "path string, value string")
    got = {r["page"]: r["text"] for r in verify.case_pages(html, window=60).collect()}
    assert got[1] == "*1 one é’" and got[2].startswith("*2 two w w") and len(got[2]) < 60 and got[5] == "*5 five" and got[6].startswith("*6 six")


def test_pages_go_on_past_other_anchors(spark):
    html = spark.createDataFrame([("a", f'<a id="p2">*2</a> old <a id="p1">*1</a> one <a id="p1">*1</a> {"w " * 50}<a href="n">*9</a> end <a id="p2">*2</a> two')], "path string, value string")
    got = {r["page"]: r["text"] for r in verify.case_pages(html, window=40).collect()}
    assert got[1] == "*1 one *1 " + "w " * 50 + "*9 end" and got[2].startswith("*2 old") and len(got[2]) < 40 and got[9].startswith("*9 end")


def test_case_pages_shuffle_no_text(spark):
    html = spark.createDataFrame([("a", '<a id="p2">*2</a> b <a id="p3">*3</a> c <a id="p2">*2</a> d'), ("e", None), ("f", ""), ("g", '<a id="p9">*9')], "path string, value string")
    made = verify.case_pages(html)
    assert sorted(map(tuple, made.collect())) == [("a", 2, "*2 b"), ("a", 3, "*3 c *2 d")]
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    many = spark.createDataFrame([("a", "".join(f'<a id="p{i}">*{i}</a> ' + "word " * 200 for i in range(1, 3001)))], "path string, value string")
    assert verify.case_pages(many).count() == 3000


def test_quotations_in_rounds(spark, tmp_path):
    texts = spark.createDataFrame([(i, f"before quote number {i} after") for i in range(20)], "doc_id long, text string")
    quotes = spark.createDataFrame([(i, f"quote number {i} after") for i in range(20)], "q long, quote string")
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    pairs = lambda **options: sorted(map(tuple, verify.verify_anywhere(quotes, texts, "q", "quote", "doc_id", "text", **options).collect()))
    assert pairs() == pairs(block=60, together=2) == [(i, i) for i in range(20)]
