import hashlib
import re
from collections import defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from fablespark.llm import mixing


def share_out(budget, children):
    """{name: (capacity, weight)} to whole amounts, filling in order of capacity per weight."""
    out, left, w_left = {}, budget, sum(w for _, w in children.values())
    level = None
    for name in sorted(children, key=lambda n: (Fraction(children[n][0], children[n][1]), n)):
        cap, w = children[name]
        if level is None and left * w < cap * w_left:
            level = (left, w_left)
        out[name] = cap if level is None else min(cap, level[0] * w // level[1])
        if level is None:
            left, w_left = left - cap, w_left - w
    return out


def plain(rows, plan):
    """rows: (doc_id, text, lang, source); {(doc_id, epoch): times taken}."""
    leaf = defaultdict(list)
    for d, t, lang, source in rows:
        n = len([w for w in re.split(r"[ \t-\r]+", t or "") if w])
        digit = re.search(r"([0-9])$", source or "")
        if n:
            leaf[f"d{int(digit[1]) % plan.n_domains if digit else 0}", lang or "", source or ""].append((str(d) if d is not None else "", n))
    supply = {k: sum(n for _, n in v) for k, v in leaf.items()}
    cap = {k: s * plan.max_epochs for k, s in supply.items()}
    total = int(sum(supply.values()) * plan.share)
    level = lambda pre: sorted({k[: len(pre) + 1] for k in cap if k[: len(pre)] == pre})
    weights = (plan.domains, plan.langs, plan.sources)

    def spread(pre, budget):
        if len(pre) == 3:
            return {pre: budget}
        children = {k[-1]: (sum(c for x, c in cap.items() if x[: len(k)] == k), weights[len(pre)].get(k[-1], plan.other)) for k in level(pre)}
        return {a: b for name, got in share_out(budget, children).items() for a, b in spread((*pre, name), got).items()}

    taken = defaultdict(int)
    for k, budget in spread((), total).items():
        for e in range(plan.max_epochs + 1):
            order = sorted((hashlib.md5(f"{plan.seed}|{e}|{d}".encode()).hexdigest(), d, n) for d, n in leaf[k])
            run = e * supply[k]
            same = defaultdict(int)
            for h, d, n in order:
                same[h, d] += n
            for h, d in sorted(same):
                run += same[h, d]
                if run <= budget:
                    taken[d, e] += sum(1 for x, _ in leaf[k] if x == d)
    return dict(taken)


PLANS = [mixing.PLAN, mixing.MixPlan(share=2.4, max_epochs=3, domains={"d1": 9}, langs={"fr": 7}, other=1), mixing.MixPlan(share=0.05), mixing.MixPlan(share=9, max_epochs=2)]


@pytest.mark.parametrize("plan", PLANS)
@pytest.mark.parametrize("limit", [mixing.BROADCAST_LEAVES, 0])
def test_against_plain(spark, sf, monkeypatch, plan, limit):
    monkeypatch.setattr(mixing, "BROADCAST_LEAVES", limit)
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("epoch", F.lit("x")).withColumn("slot", F.lit(1))
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source").collect()]
    out = mixing.mix(docs, plan)
    got = defaultdict(int)
    for r in out.select(F.col("doc_id").cast("string"), "epoch").collect():
        got[r[0], r[1]] += 1
    assert dict(got) == plain(rows, plan)


def test_odd_rows(odd_docs, no_docs):
    plan = mixing.MixPlan(share=1.0)
    out = mixing.mix(odd_docs, plan)
    assert out.columns == [*odd_docs.columns, "domain", "n_tokens", "epoch"]
    rows = out.collect()
    assert {r["doc_id"] for r in rows} <= {1, 5, 6, 7, None, 2**60 + 1}  # none without words
    taken = plain([(r["doc_id"], r["text"], r["lang"], r["source"]) for r in odd_docs.collect()], plan)
    assert len(rows) == sum(taken.values())
    assert mixing.mix(no_docs).count() == 0


def test_shortage_goes_to_siblings_first(spark):
    leaves = spark.createDataFrame([("d0", "en", "a", 10), ("d0", "en", "b", 1000), ("d1", "en", "c", 1000)], "domain string, lang string, source string, supply long")
    plan = mixing.MixPlan(share=0.5, max_epochs=1, domains={"d0": 1, "d1": 1}, langs={"en": 1}, sources={}, other=1)
    got = {r["source"]: r["budget"] for r in mixing.leaf_budgets(leaves, plan).collect()}
    assert got == {"a": 10, "b": 492, "c": 502}  # half of 2010 is split evenly by domain; what a lacks goes to b
