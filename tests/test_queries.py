"""Every query of the engine against its SQL on the smallest tables."""

import datetime

import duckdb
import pytest

import __spark_entry__
from docketry.plans import registry
from docketry.sources.views import TABLES


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, sf, duck, name):
    frame = registry.QUERIES[name](spark, sf)
    columns = sorted(frame.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in frame.collect())
    if name not in registry.ORACLES:
        assert got
        return
    ran = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in ran.description]
    assert sorted(names) == columns
    assert got == sorted(repr([plain(dict(zip(names, r, strict=True))[c]) for c in columns]) for r in ran.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["item_id", "doc_id"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_quotations_beyond_the_beginning_are_detected(spark, tmp_path):
    deep = "word " * 200 + 'he said "this stands far behind the beginning" and left'
    spark.createDataFrame([(1, deep), (2, "word " * 200), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["n_quotes"], r["text_has_quotation"]) for r in __spark_entry__.queries()["quotation_detect_whole"](spark, str(tmp_path)).collect()}
    assert got[1] == (2, True) and got[2] == (1, False) and not got[3][1]


def test_quotations_are_verified_at_any_place_and_not_by_construction(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = __spark_entry__.queries()["quote_verification_spread"](spark, sf).collect()
    missing = [r["doc_id"] for r in found if not r["found"]]
    assert missing and all(k % 3 == 0 for k in missing if len(docs[k]) > 200)
    deep = [r["doc_id"] for r in found if r["found"] and r["doc_id"] % 3 and (r["doc_id"] * 7919) % max(len(docs[r["doc_id"]]) - 59, 1) > 1000]
    assert deep
    results = {r["doc_id"]: r["result"] for r in __spark_entry__.queries()["validate_labels_spread"](spark, sf).collect()}
    assert all(results[k] == "uncertain" for k in missing) and "verified" in results.values()


def against_sql(spark, name, **tables):
    """Rows of a query over small tables that are not in its SQL's rows, and the other way round."""
    con = duckdb.connect()
    folder = tables.pop("folder")
    for table, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    ran = con.execute(registry.ORACLES[name])
    names = [d[0] for d in ran.description]
    wanted = sorted(map(repr, ran.fetchall()))
    return sorted(repr(tuple(r)) for r in registry.QUERIES[name](spark, folder).select(*names).collect()), wanted


def test_propositions_end_where_the_citation_starts(spark, tmp_path):
    rows = [
        (0, 0, "Dos lasseesador quien sabe"), (0, 2, "Dos lasses quien see of it"), (1, 0, None), (2, 0, ""), (3, 0, "... "), (4, 0, "\n\n after a line's end there is more of it"), (5, 0, "short"), (5, 1, "   "), (5, 2, "x.y"),
        (6, 0, "\u00a0\u2003 after spaces there is more of it"), (7, 2, "one of ten or more.\u2028\u2028 and on it goes"), (36, 6, "we argue that --" + " " * 30 + "-- and on"), (8, 2, "one of ten.\x0b\x85\x0b\x85\x0b\x85\x0b\x85\x0b\x85"),
    ]
    got, wanted = against_sql(spark, "propositions", folder=str(tmp_path), conversations=("conv_id long, turn int, role string, text string", [(c, t, "user", x) for c, t, x in rows]))
    assert got == wanted and any("Dos lassee" in x for x in got)


def test_case_pages_decode_the_listed_entities_only(spark, tmp_path):
    rows = [
        (0, "http://a?b=1&lt=2", "<p>cut at&amp &copy 2020 &#8217;&hellip; &amp;lt; &copy;&nbsp;&#39; a?x=1&sect=3</p>"), (1, "http://b", "x" * 4960 + "&lt;&gt;&quot;&amp;" * 20), (2, None, "<p>no address</p>"), (3, "http://c", None),
        (4, "http://d", "\x0b a\x0bb\x85c\u2028\u2003d\r\n\fe \x85"), (5, "http://e", "\U0001f600&lt;" * 900), (5, "http://f", "the same key again"),
    ]
    got, wanted = against_sql(spark, "case_pages", folder=str(tmp_path), pages=("page_id long, url string, html string", rows))
    assert got == wanted and len(got) == 21 and any("cut at&amp " in x for x in got)
