"""Quote location against brute force over every stretch of every text."""

import random

import pyarrow as pa
import pytest

from fablespark.operators import quotes
from fablespark.operators.quotes import allowed, cut, flat, locate, locate_pairs, locate_quotes, nearest


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute(text, quote, share=0.1):
    """(method, normalised stretch, distance) by trying every stretch."""
    wanted, plain = flat(quote), flat(text)
    if not wanted:
        return None
    if quote in text:
        return "exact", None, 0
    if wanted in plain:
        return "normalised", wanted, 0
    k = allowed(len(wanted), share)
    table = [(distance(wanted, plain[a:b]), b, b - a) for a in range(len(plain)) for b in range(a + max(1, len(wanted) - k), min(len(plain), a + len(wanted) + k) + 1)]
    best = min((x for x in table if x[0] <= k), default=None)
    return ("fuzzy", plain[best[1] - best[2] : best[1]], best[0]) if best and k else None


WORDS = "the fox jumped over lazy dogs today and ran Home; a very (old) wall, with moss. über straße no. 7".split()


def drifted(rng, text):
    words = text.split()
    i = rng.randrange(len(words))
    kind = rng.randrange(6)
    if kind == 0:
        words.insert(i, "so")
    elif kind == 1 and len(words) > 3:
        del words[i]
    elif kind == 2:
        words[i] = words[i][:2] + " " + words[i][2:]
    elif kind == 3:
        words[i] = words[i][:1] + "q" + words[i][2:]
    elif kind == 4:
        words[i] = words[i].upper() + "!"
    return " ".join(words)


def test_all_pairs_against_brute_force(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(0, 45))) for _ in range(14)] + ["", "?!"]
    asked = ["", "...", "the", "q"]
    for t in texts[:12]:
        w = t.split()
        if len(w) > 12:
            a = rng.randrange(len(w) - 10)
            asked += [drifted(rng, " ".join(w[a : a + rng.randrange(4, 11)])) for _ in range(3)]
    chunks = spark.createDataFrame([*enumerate(texts), (90, None), (None, "the fox")], "chunk_id long, text string").repartition(3)
    rows = spark.createDataFrame([*enumerate(asked), (91, None), (None, "the")], "quote_id long, quote string")
    found = {(r["chunk_id"], r["quote_id"]): r for r in locate_quotes(chunks, rows).collect()}
    methods = set()
    for c, text in enumerate(texts):
        for q, quote in enumerate(asked):
            want, got = brute(text, quote), found.pop((c, q), None)
            assert (got is None) == (want is None), (text, quote)
            if want:
                assert (got["method"], got["distance"]) == (want[0], want[2])
                span = text[got["first_char"] - 1 : got["last_char"]]
                assert span == quote if want[0] == "exact" else flat(span) == want[1].strip()
                methods.add(want[0])
    assert not found and methods == {"exact", "normalised", "fuzzy"}


@pytest.mark.parametrize("change", [lambda w: [*w[:9], "jumped", *w[9:]], lambda w: w[:7] + w[8:], lambda w: [*w[:5], w[5][:2], w[5][2:], *w[6:]]])
def test_inserted_lost_and_split_words(spark, change):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9)))
    said = [word() for _ in range(25)]
    texts = [(i, " ".join([*(word() for _ in range(50)), *(change(said) if i % 2 else []), *(word() for _ in range(50))])) for i in range(6)]
    found = locate_quotes(spark.createDataFrame(texts, "chunk_id int, text string"), spark.createDataFrame([("q", " ".join(said))], "quote_id string, quote string")).collect()
    assert sorted((r["chunk_id"], r["method"]) for r in found) == [(1, "fuzzy"), (3, "fuzzy"), (5, "fuzzy")]


def test_split_word_of_the_review():
    assert locate("He saw the fox jump ed over lazy dogs today again.", "the fox jumped over lazy dogs today")[:3] == ("fuzzy", 8, 43)


def test_a_seed_that_every_text_and_quote_share(spark):
    texts = [(i, f"and the story of the old house {i} goes on and on, and the story of the old house ends {i}") for i in range(200)]
    asked = [(i, f"and the story of the old house ends {i}") for i in range(200)]
    found = locate_quotes(spark.createDataFrame(texts, "chunk_id int, text string"), spark.createDataFrame(asked, "quote_id int, quote string"))
    exact = {(r[0], r[1]) for r in found.filter("method = 'exact'").collect()}
    assert {(i, i) for i in range(200)} <= exact and exact == {(i, j) for i, t in texts for j, q in asked if q in t}


def test_few_bits_lose_nothing(spark, monkeypatch):
    chunks = spark.createDataFrame([(i, f"alpha beta {i} gamma delta epsilon {i * 7} zeta eta theta") for i in range(50)], "chunk_id int, text string")
    asked = spark.createDataFrame([(i, f"beta {i} gamma delta epsilom {i * 7} zeta") for i in range(50)], "quote_id int, quote string")
    want = sorted(map(tuple, locate_quotes(chunks, asked).collect()))
    monkeypatch.setattr(quotes, "MAX_BITS", 15)
    monkeypatch.setattr(quotes, "SEED_SIZES", (2, 1))
    assert sorted(map(tuple, locate_quotes(chunks, asked).collect())) == want and {r[:2] for r in want} >= {(i, i) for i in range(50)}


def test_known_pairs(spark):
    rows = [(1, "Yes, he SAID so.", "he said"), (2, "Yes", None), (3, None, "Yes"), (4, "the quick brown fox jumps", "quick browm fox"), (5, "x", "y")]
    found = locate_pairs(spark.createDataFrame(rows, "id int, page string, quote string"), ["id"], "page").collect()
    assert [tuple(r) for r in found] == [(1, "normalised", 6, 12, 0), (2, None, None, None, None), (3, None, None, None, None), (4, "fuzzy", 5, 19, 1), (5, None, None, None, None)]


def test_pieces_and_distances():
    for n in range(1, 400):
        pieces, wanted = cut("x" * n)
        assert "".join(p for _, p in pieces) == "x" * n and all(p for _, p in pieces) and len(pieces) == allowed(n) + wanted
    rng = random.Random(8)
    for _ in range(200):
        a, b = ("".join(rng.choice("ab ") for _ in range(rng.randrange(1, 12))) for _ in range(2))
        ends = [(min(distance(a, b[i:j]) for i in range(j + 1)), j) for j in range(len(b) + 1)]
        assert nearest(a, b) == min(ends)
        assert nearest(a, b, from_start=True) == min([(distance(a, b[:j]), j) for j in range(len(b) + 1)])


def test_empty_tables(spark):
    none = spark.createDataFrame([], "chunk_id int, text string")
    asked = spark.createDataFrame([(1, "abc")], "quote_id int, quote string")
    assert locate_quotes(none, asked).count() == 0
    assert locate_quotes(spark.createDataFrame([(1, "abc")], "chunk_id int, text string"), asked.limit(0)).count() == 0


def test_drift_in_documents_that_hold_the_quote_as_its_sql(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry

    quote = "The cafe keeper poured another cup of coffee before the clock struck seven in the evening"
    lost = quote.replace("of ", "").replace("coffee ", "", 1)
    texts = [f"So: {quote}.", f"Near {quote.replace('clock', 'cloak')}.", quote.upper(), f"{quote.upper()} {quote.replace('coffee ', '').upper()}", f"{quote} {lost}", "nothing"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, quote), (1, "by twos")], "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = db.execute(entry.oracle_sql()["quote_drift"]).fetchall()
    found = [tuple(r) for r in entry.queries()["quote_drift"](spark, str(tmp_path)).collect()]
    assert sorted(found) == sorted(want) and {r[0] for r in want} == {0, 2, 3, 4}


def test_a_batch_of_long_texts_is_worked_on_in_slices(spark, monkeypatch):
    """no more characters at once than a slice has, or the one text that is longer; same finds."""
    texts = ["long words " * n + f"the quote number {n % 3} here" for n in (0, 5, 400, 3, 0, 90, 1)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array([*texts, None])], names=["chunk_id", "text"])
    monkeypatch.setattr(quotes, "SLICE_CHARS", 1000)
    cut = list(quotes.slices(iter([batch]), 1))
    assert [r for b in cut for r in b.to_pylist()] == batch.to_pylist() and len(cut) > 3
    assert all(b.num_rows == 1 or sum(len(t or "") for t in b.column(1).to_pylist()) <= 1000 for b in cut)
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id int, text string").coalesce(1)
    asked = spark.createDataFrame([(n, f"The quote number {n} HERE") for n in range(3)], "quote_id int, quote string")
    assert {(r["chunk_id"], r["quote_id"]) for r in quotes.locate_quotes(chunks, asked, 0.0).collect()} == {(i, int(t.split()[-2])) for i, t in enumerate(texts)}


def test_both_ways_of_meeting_against_brute_force(spark, monkeypatch):
    """few quotes are sent to the texts and nothing is shuffled; many meet them by a join; the same finds."""
    chunks = spark.createDataFrame([(i % 4, f"{'alpha ' * (i % 5)}beta {i % 3} gamma delta epsilon zeta eta") for i in range(12)], "chunk_id int, text string")
    asked = spark.createDataFrame([("a", "beta 1 gamma delta epsilom zeta"), ("a", "BETA 2"), ("b", "alpha alpha, beta 0"), ("c", "..."), ("d", "gamma delta")], "quote_id string, quote string")
    near = locate_quotes(chunks, asked)
    assert "Exchange" not in near._jdf.queryExecution().toString()
    want = sorted(map(tuple, near.collect()))
    monkeypatch.setattr(quotes, "NEAR_HITS", 10)
    assert sorted(map(tuple, locate_quotes(chunks, asked).collect())) == want and len(want) > 20
    monkeypatch.setattr(quotes, "NEAR_SEEDS", -1)
    assert sorted(map(tuple, locate_quotes(chunks, asked).collect())) == want
    test_all_pairs_against_brute_force(spark)
