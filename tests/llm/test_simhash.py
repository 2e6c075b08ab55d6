import math
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from fablespark.llm import queries, simhash
from fablespark.llm.components import star_components

M = (1 << 64) - 1


def plain_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """prints: {doc_id: unsigned fingerprint}; the least reachable id of each."""
    ids = sorted(prints)
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and bin(prints[a] ^ prints[b]).count("1") <= 2:
                up[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in ids}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("text", [None, "", " \n", "one", "one two", "A b C", "a b c d", "x " * 500, "Äpfel ÄPFEL äpfel", "a\x0bb\x0cc\u00a0d e"])
def test_fingerprint_matches_the_plain_one(text):
    assert simhash.fingerprint_of(text) & M == plain_fingerprint(text)


@pytest.mark.parametrize("seed", [5, 6, 7])
def test_links_are_those_of_brute_force(spark, seed):
    rnd = random.Random(seed)
    prints = {}
    for g in range(12):
        base, n = rnd.getrandbits(64), rnd.choice([1, 2, 30, 60])
        walk = base
        for k in range(n):
            walk ^= (1 << rnd.randrange(64)) if rnd.random() < 0.8 else (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64))
            prints[1000 * g + k] = walk & M
    prints |= {90_000: 0, 90_001: 0, 90_002: M, 90_003: M ^ 1 ^ (1 << 63), 90_004: 1 << 63}
    nodes = spark.createDataFrame([(k, signed(v)) for k, v in prints.items()], "rep long, fp long").groupBy("fp").agg(F.min("rep").alias("rep"))
    roots = {r["node"]: r["root"] for r in star_components(simhash.near_links(nodes)).collect()}
    reps = {r["fp"]: r["rep"] for r in nodes.collect()}
    got = {k: roots.get(reps[signed(v)], reps[signed(v)]) for k, v in prints.items()}
    assert got == plain_components(prints)


def test_tally_of_lists_counts_shared_bytes(spark):
    """Pairs that share fewer than six bytes meet in no list, the others in as many as there are choices of six."""
    base = 0x1122334455667788
    prints = {s: base ^ sum(0xFF << (8 * p) for p in range(8 - s)) for s in range(9)}
    nodes = spark.createDataFrame([(s, signed(v & M)) for s, v in prints.items()], "rep long, fp long")
    posts = simhash._postings(nodes, 6)
    base_lists = {(r["positions"], r["bytes"]) for r in posts.filter("rep = 8").collect()}
    met = {s: sum((r["positions"], r["bytes"]) in base_lists for r in posts.filter(F.col("rep") == s).collect()) for s in range(8)}
    assert met == {s: math.comb(s, 6) for s in range(8)}


def test_query_against_brute_force(spark, sf):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op8_simhash(spark, sf).collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    prints = {k: plain_fingerprint(t) for k, t in texts.items()}
    parts = plain_components(prints)
    assert got == {k: (f"{v:016x}", parts[k]) for k, v in prints.items()}


def test_odd_rows(odd_docs, no_docs):
    rows = simhash.near_duplicates(odd_docs).collect()
    assert len(rows) == 11
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert len(by[1]) == 2 and by[6][0]["component_id"] == 1  # A-Z are lower-cased
    assert {r["component_id"] for i in (2, 3, 4) for r in by[i]} == {2}  # no words: fingerprint zero, linked
    assert all(r["component_id"] is None for r in by[None])
    assert by[2**60 + 1][0]["component_id"] == 2**60 + 1
    assert simhash.near_duplicates(no_docs).count() == 0


def test_one_of_each_group(odd_docs, no_docs):
    kept = simhash.one_of_each_group(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 2, 5, 7, 2**60 + 1] and ids.count(None) == 2
    assert simhash.one_of_each_group(no_docs).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in star_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {100 + i: 100 for i in range(1, 50)}


def test_tally_of_shared_bytes(spark):
    """The lists that a pair meets in tell its shared bytes; pairs under the minimum are not retained."""
    rng = random.Random(12)
    base = [rng.randrange(1 << 64) for _ in range(30)]
    fps = {f for x in base for f in (x, x ^ 1, x ^ (1 << 9), x ^ 1 ^ (1 << 63), x ^ 7, x ^ 0x010101, x ^ 0x0101010101)}
    signed = {f: f - (1 << 64) if f >= 1 << 63 else f for f in fps}
    nodes = spark.createDataFrame(list(enumerate(signed.values())), "rep long, fp long")
    of = {v: k for k, v in signed.items()}
    shared = lambda a, b: sum(x == y for x, y in zip(a.to_bytes(8, "big"), b.to_bytes(8, "big"), strict=True))
    for least in (6, 5):
        found = {(of[r["left"]], of[r["right"]]): r["shared"] for r in simhash.shared_bytes(nodes, least).collect()}
        want = {(a, b): shared(a, b) for a in fps for b in fps if signed[a] < signed[b] and shared(a, b) >= least}
        assert found == want
    # With five bytes in the index the count filter takes the pairs under six away, and the links are the same.
    assert set(want.values()) == {5, 6, 7} and sorted(simhash.near_links(nodes, least_shared=5).collect()) == sorted(simhash.near_links(nodes).collect())


def test_the_row_that_stays_is_chosen_by_a_rule(spark):
    rows = [(1, "one two three", "a", 1), (1, "four five six", "b", 2), (1, "four five six", "c", 3), (2, "seven eight nine ten", "d", 4)]
    kept = {tuple(simhash.one_of_each_group(spark.createDataFrame(rows[i:] + rows[:i], "doc_id long, text string, lang string, n int").repartition(1 + i)).filter("doc_id = 1").first()) for i in range(4)}
    assert len(kept) == 1
