import random

import pytest

from fablespark.llm import shingle_links, simhash
from fablespark.llm.components import star_components


def plain_shingles(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def plain_groups(texts):
    """texts: [(doc_id, text)]; the least reachable id of each by similarity of 0.8 or more."""
    sets = [(i, plain_shingles(t)) for i, t in texts if i is not None]
    up = {i: i for i, _ in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            if 5 * len(x & y) >= 4 * len(x | y):
                up[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in up}


def groups(links, ids):
    roots = {r["node"]: r["root"] for r in star_components(links).collect()}
    return {i: roots.get(i, i) for i in ids}


@pytest.fixture(scope="module")
def copies():
    """A large group of near copies with drift, and small groups of edited texts."""
    rnd = random.Random(3)
    rows, n = [], 0
    for size, length, edits in [(150, 200, 2), *[(3, 120, 1)] * 30, *[(2, 400, 8)] * 20, *[(2, 60, 4)] * 20]:
        base = [f"w{rnd.randrange(3000)}" for _ in range(length)]
        for _ in range(size):
            words = list(base)
            for _ in range(rnd.randint(0, edits)):
                words[rnd.randrange(length)] = f"x{rnd.randrange(10**6)}"
            rows.append((n, " ".join(words)))
            n += 1
    return rows


def test_links_are_those_of_brute_force(spark, copies):
    df = spark.createDataFrame(copies, "doc_id long, text string")
    want = plain_groups(copies)
    assert groups(shingle_links.shingle_links(df), list(want)) == want
    assert len(set(want.values())) < len(want)


def test_documents_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    want = plain_groups([tuple(r) for r in docs.collect()])
    assert groups(shingle_links.shingle_links(docs), list(want)) == want


def test_one_of_each_group_takes_near_copies(spark, copies):
    want = plain_groups(copies)
    kept = simhash.one_of_each_group(spark.createDataFrame(copies, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))


def test_odd_rows(spark, odd_docs, no_docs):
    links = {(r["u"], r["v"]) for r in shingle_links.shingle_links(odd_docs).collect()}
    assert groups(shingle_links.shingle_links(odd_docs), [1, 2, 3, 4, 5, 6, 7]) == {1: 1, 2: 2, 3: 2, 4: 2, 5: 5, 6: 1, 7: 7} and links
    assert shingle_links.shingle_links(no_docs).count() == 0
    two = spark.createDataFrame([(1, "a b c d e f"), (1, "g h i j k l"), (2, "g h i j k l"), (3, "a b c d e f")], "doc_id long, text string")
    assert groups(shingle_links.shingle_links(two), [1, 2, 3]) == {1: 1, 2: 1, 3: 1}
