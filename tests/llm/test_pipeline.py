from collections import Counter

import corpus_pipeline as cp
from fablespark.llm import mixing, quality, toxicity
from fablespark.llm.components import star_components

from test_decontaminate import plain as plain_leaks
from test_mixing import plain as plain_mix
from test_shingle_links import plain_groups
from test_simhash import plain_components, plain_fingerprint


def test_against_plain_version(spark, sf):
    """The classifiers' models are taken as they are; all decisions are made again in plain Python."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = [r for r in docs.collect()]
    tox = toxicity.train_toxicity(docs, labels)
    rows = [r for r, s in zip(rows, tox.scores(toxicity.FEATURES, [r["text"] for r in rows]), strict=True) if s < toxicity.THRESHOLD]
    good = quality.train_quality(spark.createDataFrame(rows, docs.schema), labels)
    rows = [r for r, s in zip(rows, good.scores(quality.FEATURES, [r["text"] for r in rows]), strict=True) if s >= quality.THRESHOLD]
    parts = plain_components({r["doc_id"]: plain_fingerprint(r["text"]) for r in rows})
    alike = plain_groups([(r["doc_id"], r["text"]) for r in rows])
    links = [(i, j) for found in (parts, alike) for i, j in found.items() if i != j]
    gone = {r["node"] for r in star_components(spark.createDataFrame(links, "u long, v long")).collect()}
    rows = [r for r in rows if r["doc_id"] not in gone]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    leaks = {d for d, _ in plain_leaks([(r["doc_id"], r["text"]) for r in rows], items)}
    rows = [r for r in rows if r["doc_id"] not in leaks]
    want = plain_mix([(r["doc_id"], r["text"], r["lang"], r["source"]) for r in rows], mixing.PLAN)
    got = Counter((str(r["doc_id"]), r["epoch"]) for r in cp.run(spark, sf).collect())
    assert dict(got) == want and leaks


def test_stages_take_odd_and_empty_tables(spark, sf, odd_docs, no_docs):
    docs = odd_docs
    for k, (_, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, sf)
        empty = stage(spark, no_docs, sf)
        assert empty.count() == 0
        if k < len(cp.STAGES) - 1:
            assert out.columns == docs.columns and empty.columns == docs.columns
            assert [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]
        out.count()


def test_stage_order():
    assert [n for n, _ in cp.STAGES] == ["toxicity", "quality", "near_duplicates", "decontamination", "mixing"]
