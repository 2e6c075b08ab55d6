import random
import re

import pytest

from fablespark.llm import decontaminate as dc


def words(t):
    return [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]


def shingles(w, n):
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def plain(docs, items, t=0.8):
    out = {}
    for i, it in items:
        w = words(it)
        if i is None or not w:
            continue
        n = min(5, len(w))
        own = shingles(w, n)
        for d, text in docs:
            m = len(own & shingles(words(text), n))
            if d is not None and m / len(own) >= t:
                out[d, i] = max(out.get((d, i), (0, 0)), (m, len(own)))
    return out


def cases():
    rnd = random.Random(8)
    vocab = [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    items = [(i, text(rnd.randint(1, 60))) for i in range(25)] + [(90, None), (None, text(9)), (91, ""), (92, "w1 w2"), (93, "W1, W2!")]
    docs = []
    for d in range(80):
        t = text(rnd.choice([3, 40, 400]))
        if d % 2:
            w = words(rnd.choice(items[:25])[1])
            for _ in range(rnd.choice([0, 0, 1, 2, 5])):
                w[rnd.randrange(len(w))] = "changed"
            t = f"{t} {', '.join(w).upper()} {text(10)}"
        docs.append((d, t))
    docs += [(200, None), (201, ""), (None, items[0][1]), (3, docs[3][1]), (202, " ".join(vocab * 800) + " " + items[5][1])]
    return docs, items


@pytest.mark.parametrize("rows,chars", [(dc.BROADCAST_ROWS, dc.BROADCAST_CHARS), (0, 0)])
def test_against_brute_force(spark, monkeypatch, rows, chars):
    monkeypatch.setattr(dc, "BROADCAST_ROWS", rows)
    monkeypatch.setattr(dc, "BROADCAST_CHARS", chars)
    docs, items = cases()
    d = spark.createDataFrame([(*x, 1, "h") for x in docs], "doc_id long, text string, item_id int, hash string")
    i = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["n_shared"], r["n_shingles"]) for r in dc.contaminated(d, i).collect()}
    assert got == plain(docs, items)
    kept = dc.decontaminate(d, i)
    assert kept.columns == d.columns
    bad = {k for k, _ in plain(docs, items)}
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == sorted((x or -1) if x is not None else -1 for x, _ in docs if x not in bad)


def test_signatures_never_lose_a_pair(spark):
    """Any choice of the shingles that a match may miss leaves one of the signature."""
    sets = dc.item_sets(spark.createDataFrame([(1, " ".join(f"a{i}" for i in range(40)))], "item_id long, text string"))
    n = sets.first()["n"]
    assert dc.signatures(sets).count() > int(0.2 * n)


@pytest.mark.parametrize("rows", [dc.BROADCAST_ROWS, 0])
def test_repeated_items(spark, monkeypatch, rows):
    """Equal rows and other texts under one id: documents that lack some shingles of one text."""
    monkeypatch.setattr(dc, "BROADCAST_ROWS", rows)
    items, docs = [], []
    for i in range(12):
        texts = [[f"i{i}t{t}w{k}" for k in range(20)] for t in range(2)]
        items += [(i, " ".join(texts[0]))] * 4 + [(i, " ".join(w)) for w in texts]
        for t, w in enumerate(texts):
            docs += [(len(docs) + n, f"some {' '.join(x)} more") for n, x in enumerate([w, w[1:], w[:-1], w[3:], w[:-3], w[2:-1], w[4:]])]
    got = dc.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]): (r["n_shared"], r["n_shingles"]) for r in got} == plain(docs, items)
    assert len(got) == 12 * 2 * 6 and min(r["containment"] for r in got) == 13 / 16


def test_empty_tables(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "one two three four five six seven")], "item_id long, text string")
    assert {r["doc_id"] for r in dc.contaminated(odd_docs, items).collect()} == {1, 6}
    assert dc.contaminated(no_docs, items).count() == 0 and dc.contaminated(odd_docs, items.limit(0)).count() == 0
    assert dc.decontaminate(odd_docs, items.limit(0)).count() == 11
    assert dc.decontaminate(odd_docs, items).count() == 8


def test_runs_no_python(spark, odd_docs):
    items = spark.createDataFrame([(1, "one two three four five six seven")], "item_id long, text string")
    assert "Python" not in dc.contaminated(odd_docs, items)._jdf.queryExecution().executedPlan().toString()
