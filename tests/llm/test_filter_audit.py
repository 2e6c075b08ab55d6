"""The filter audit against a plain version that applies every order to every document."""

import re
from itertools import permutations

from pyspark.sql import functions as F

from fablespark.llm import filter_audit
from fablespark.llm.filter_audit import audit_filters, text_failures

LABELS = "doc_id long, quality int, toxic int, part string, bits int"


def failures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search(r"[#$%&*|]", text))}


def plain(docs, labels):
    rows = [(d, lang or "", t or "") for d, lang, t in docs]
    marked = {k: {d for d, *ms in labels if d is not None and ms[i] == 1} for i, k in enumerate(("good_lost", "toxic_lost"))}
    fails = [failures(t) | {"E": d is not None and any(e is not None and e < d and u == t for e, _, u in rows)} for d, _, t in rows]
    out = {}
    for order in permutations("ABCDE"):
        gone = [False] * len(rows)
        for step, f in enumerate(order, 1):
            for part in {r[1] for r in rows}:
                mine = [i for i, r in enumerate(rows) if r[1] == part]
                now = [i for i in mine if fails[i][f] and not gone[i]]
                lost = [len([i for i in now if rows[i][0] in ids]) for ids in marked.values()]
                out[part, "".join(order), step] = [len([i for i in mine if not gone[i] and not fails[i][f]]), len(now), len([i for i in mine if fails[i][f] and gone[i]]), len([i for i in mine if fails[i][f] and sum(fails[i].values()) == 1]), *lost]
            gone = [g or x[f] for g, x in zip(gone, fails, strict=True)]
    total = {}
    for (part, order, step), v in out.items():
        total[part, order[step - 1]] = total.get((part, order[step - 1]), 0) + v[1]
    return sorted((*k, *v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items())


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_awkward_rows(spark, odd_docs):
    labels = [(1, 1, 0), (1, 0, 0), (2, 1, 1), (None, 1, 1), (6, None, 1), (99, 1, 1)]
    found = audit_filters(odd_docs, spark.createDataFrame([(*x, "p", 3) for x in labels], LABELS))
    rows = [(r["doc_id"], r["lang"], r["text"]) for r in odd_docs.collect()]
    assert sorted(tuple(r) for r in found.select(*COLUMNS).collect()) == plain(rows, labels)


def test_many_partitions_parts_and_copies(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "HELD_PARTS", 3)
    words = ["alpha", "Beta", "GAMMA", "x#y", "delta", " wide", "É"]
    texts = [" ".join(words[(i * k + j) % 7] + str(j if i % 3 else j % 20) for j in range(i % 4 * 60)) for i in range(11) for k in (1, 2)]
    rows = [(i, f"l{i % 13}" if i % 5 else None, texts[i % 7 if i % 2 else i % len(texts)]) for i in range(150)]
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 150, 2)]
    labels = [(a, b, int(c)) for a, b, c in labels]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(5)
    found = audit_filters(docs, spark.createDataFrame([(*x, "p", 3) for x in labels], LABELS))
    assert sorted(tuple(r) for r in found.select(*COLUMNS).collect()) == plain(rows, labels)


def test_word_bounds():
    assert text_failures("a\x1cb" * 200) & 1  # \x1c is no separator
    assert not text_failures("\x0b".join(map(str, range(100)))) & 1
    assert text_failures("") == 1
    assert text_failures("|") >> 3 & 1


def test_empty_table(spark, no_docs):
    assert audit_filters(no_docs, spark.createDataFrame([], LABELS)).count() == 0


def test_extra_columns_do_not_clash(spark):
    docs = spark.createDataFrame([(1, "a", "en", 7, "x")], "doc_id long, text string, lang string, bits int, hash string").withColumn("first", F.lit(1))
    assert audit_filters(docs, spark.createDataFrame([], LABELS)).count() == 600
