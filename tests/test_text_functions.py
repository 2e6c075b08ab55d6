import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fablespark.functions import text as T
from fablespark.functions.position import at_or_before
from fablespark.operators import chapters

ROMANS = {1: "I", 4: "IV", 9: "IX", 14: "XIV", 40: "XL", 90: "XC", 400: "CD", 1994: "MCMXCIV", 3999: "MMMCMXCIX"}


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("number,roman", ROMANS.items())
def test_roman(spark, number, roman):
    assert one(spark, T.roman_to_int(F.lit(roman.lower()))) == number
    assert one(spark, T.chapter_number(F.lit(roman), strict=True)) == number


@pytest.mark.parametrize("text,loose,strict", [("3", 3, 3), ("3.1", 3, 3), ("IIII", 4, None), ("VX", 5, None), ("IC", 99, None), ("x1", None, None), ("", None, None)])
def test_chapter_number(spark, text, loose, strict):
    assert one(spark, T.chapter_number(F.lit(text))) == loose
    assert one(spark, T.chapter_number(F.lit(text), strict=True)) == strict


def test_strict_headings_want_a_boundary(spark):
    h = T.parse_heading(F.lit("Chapter Discovery"))
    s = T.parse_heading(F.lit("Chapter Discovery"), strict=True)
    assert one(spark, h["number"]) == 501 and one(spark, s["is_chapter"]) is False
    assert one(spark, T.parse_heading(F.lit(None).cast("string"))["is_chapter"]) is False


def test_budget(spark):
    assert one(spark, T.item_budget(F.lit(16384), F.lit(1000), F.lit(2048))) == int(16384 * 0.9) - 1000 - 2048
    assert one(spark, T.item_budget(F.lit(100), F.lit(1000), F.lit(2048))) == 0


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=30), st.integers(1, 60))
def test_packing_loses_nothing_and_keeps_budgets(spark, sizes, budget):
    got = one(spark, T.pack_greedy(F.array(*map(F.lit, sizes)), F.array(*[F.lit(budget)] * len(sizes))))
    assert len(got) == len(sizes) and got == sorted(got) and got[0] == 0
    for b in set(got):
        members = [s for s, x in zip(sizes, got, strict=True) if x == b]
        assert sum(members) <= budget or len(members) == 1
    for a, b in zip(range(len(got)), got[1:], strict=False):
        if b != got[a]:  # a new batch starts only where the item didn't fit
            assert sum(s for s, x in zip(sizes, got, strict=True) if x == got[a]) + sizes[a + 1] > budget


def test_chunks_split_oversized_lines(spark):
    docs = spark.createDataFrame([(1, "a b c\n\n" + " ".join(["w"] * 25) + "\nd"), (2, None), (3, " \n ")], "doc_id int, text string")
    rows = chapters.chunk_documents(docs, max_tokens=10).orderBy("doc_id", "chunk_no").collect()
    assert [r["doc_id"] for r in rows] == [1] * len(rows) and all(r["token_count"] <= 10 for r in rows)
    assert " ".join(" ".join(r["chunk_text"] for r in rows).split()) == "a b c " + " ".join(["w"] * 25) + " d"


def test_pages_keep_repeats_and_missing_ones_are_set_apart(spark):
    rows = spark.createDataFrame([(1, [[3, 1], [3]]), (2, [[]])], "id int, item_pages array<array<int>>")
    got = chapters.page_provenance(rows).collect()
    assert [(r["pages"], r["page_start"], r["page_end"]) for r in got] == [([1, 3, 3], 1, 3)]
    assert [r["id"] for r in chapters.without_provenance(rows).collect()] == [2]


def test_null_chapter_counts_as_zero_on_both_sides(spark):
    rows = spark.createDataFrame([(1, None), (1, 5), (2, None), (2, 1), (3, None)], "b int, c int")
    seen = lambda b, c: rows.filter(at_or_before(F.col("b"), F.col("c"), b, c)).count()
    assert seen(2, 0) == 3 and seen(2, None) == 3 and seen(1, 4) == 1 and seen(3, 0) == 5


def test_auto_numbers_count_chapters_only_when_asked(spark):
    rows = spark.createDataFrame([(1, 1, None, True), (1, 2, None, False), (1, 3, None, True), (1, 4, 9, True), (1, 5, None, True)], "book int, at int, number int, ch boolean")
    every = [r["auto_number"] for r in chapters.auto_number(rows, ["book"], "at").orderBy("at").collect()]
    some = [r["auto_number"] for r in chapters.auto_number(rows, ["book"], "at", only=F.col("ch")).orderBy("at").collect()]
    assert every == [1, 2, 3, 9, 10] and some == [1, None, 2, 9, 10]


@pytest.mark.parametrize("text,yes", [("20.118.157.107 Betz +1 (726) 555-7857", False), ("12:30 at the station", False), ("20. The Station", True), ("4: 1066", True), ("IV - Home", True), ("20", True)])
def test_longer_numbers_are_no_chapter_headings(spark, text, yes):
    assert one(spark, T.parse_heading(F.lit(text))["is_chapter"]) is yes


@pytest.mark.parametrize("text,yes", [("Vi. Et pa dans le reste", False), ("Ci.", False), ("Mix: How to", False), ("CI.!! DIE!! ENTE!!", False), ("VI. THE RETURN", True), ("iv: the return", True), ("VI", True), ("tWo - Home", True), ("3: A Day", True)])
def test_words_of_roman_letters_are_no_numerals(spark, text, yes):
    assert one(spark, T.parse_heading(F.lit(text))["is_chapter"]) is yes


def test_heading_pages_as_in_its_sql(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry

    pages = [(1, "<h1>Vi. Et\x0bpa \n dans</h1>"), (2, "<h1> CI.!! DIE </h1>"), (3, "no heading"), (4, None), (5, "<h1>\x0bA b\r\n</h1><h1>c</h1>")]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    want = db.execute(entry.oracle_sql()["heading_pages"]).fetchall()
    assert sorted(tuple(r) for r in entry.queries()["heading_pages"](spark, str(tmp_path)).collect()) == sorted(want)
