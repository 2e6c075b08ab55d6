import json
import os
import re
import shutil
import subprocess
import sys
import unicodedata
from collections import Counter
from itertools import combinations
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from fablespark.functions.text import HONORIFICS
from fablespark.operators import characters, evals, ops, retrieval
from fablespark.plans import ask, ingest
from fablespark.sources import gold, models, stores
from fablespark.sources.schema import STAGES
from fablespark.streaming import streams


def test_entry_runs(spark):
    rows = entry.entry(spark).collect()
    assert rows and all(r["subject"] == 3 and (r["last_book_order"], r["last_chapter"]) <= (2, 6) for r in rows)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 90


def test_entry_without_the_corpus_operators(tmp_path):
    """Both of their folders and the pipeline's file can be taken out of a checkout; or the folders alone."""
    root = Path(entry.__file__).parent
    gone = shutil.ignore_patterns("llm", ".git", "__pycache__")
    shutil.copytree(root, tmp_path / "rest", ignore=gone)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(k.startswith('op1_') or k == 'pipeline' for k in e.queries()))"
    for _ in range(2):
        said = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path / "rest", env={**os.environ, "PYTHONPATH": ""}, capture_output=True, text=True, timeout=120, check=True).stdout
        n, sql, corpus = said.split()
        assert int(n) > 90 and 90 < int(sql) <= int(n) and corpus == "False"
        (tmp_path / "rest" / "corpus_pipeline.py").unlink(missing_ok=True)


def test_resume_points():
    assert ingest.remaining_stages() == STAGES and ingest.remaining_stages("graph.upsert") == ("graph.upsert",)
    with pytest.raises(ValueError, match="unknown stage"):
        ingest.remaining_stages("nope")


@pytest.fixture(scope="module")
def novel(spark):
    text = lambda n: f"Chapter {n}: Start\nKei met Nagare at noon. Mr. Darcy left.\nChapter {n + 1}: End\nKei and Hirai spoke. KEI went home with Nagare."
    return spark.createDataFrame([("b1", 1, text(1)), ("b2", 2, text(3))], "book_id string, book_order int, text string")


def test_chain_resumes_and_is_idempotent(spark, novel, tmp_path):
    first = ingest.ingest(spark, {"document": novel}, f"file://{tmp_path}")
    sums = {t: stores.checksum(first[t]).first() for t in ("character", "graph_edge", "mention")}
    again = ingest.ingest(spark, {"document": novel}, f"file://{tmp_path}", "relations.extract")
    assert {t: stores.checksum(again[t]).first() for t in sums} == sums
    assert again["graph_edge"].filter("evidence_count < 1").count() == 0
    books = {tuple(r["appears_in_books"]) for r in again["character"].collect()}
    assert (1, 2) in books  # one identity over both books


def test_pairs_of_a_character_everywhere_are_dealt_over_tasks(spark, monkeypatch):
    """rows that go to where pairs meet are one a chunk and subject, and one subject's pairs are no single task."""
    here = [(f"c{c}", 1 + c % 3, None, c, i) for c in range(40) for i in (0, *range(1 + c % 5, 30, 3))]
    mention = spark.createDataFrame(here + here[:9], "chunk_id string, book_order int, chapter int, page int, character_id long")
    want = Counter((a, b) for c in range(40) for a, b in combinations(sorted({r[4] for r in here if r[0] == f"c{c}"}), 2))
    monkeypatch.setattr(ingest, "TASK_PAIRS", 100)
    made = ingest.extract_relations({"mention": mention})["assertion"]
    spread = made.filter("subject = 0").groupBy(F.spark_partition_id()).count().collect()
    assert len(spread) > 1 and max(r["count"] for r in spread) < 250 < sum(r["count"] for r in spread)
    edges = ingest.aggregate_relations({"assertion": made})["edge"]
    assert {(r["subject"], r["object"]): r["evidence_count"] for r in edges.collect()} == want
    assert not re.search(r"hashpartitioning\([^)]*object", edges._jdf.queryExecution().executedPlan().toString())


@pytest.mark.parametrize("step", [1, (1 << 60) // 29])
def test_edges_of_meetings_are_those_of_their_assertions(spark, monkeypatch, step):
    """pairs become edges without a row an assertion, the same to the last bit; large subjects in parts."""
    here = [(f"c{c}", None if c % 11 == 0 else 1 + c % 3, None if c % 4 == 0 else c % 5, 1 + c % 6, i * step) for c in range(40) for i in (0, *range(1 + c % 5, 30, 3))]
    mention = spark.createDataFrame([*here, ("alone", 1, 1, 1, 5)], "chunk_id string, book_order int, chapter int, page int, character_id long")
    monkeypatch.setattr(ingest, "TASK_PAIRS", 100)
    made = ingest.extract_relations({"mention": mention})
    want, got = (ingest.aggregate_relations({k: made[k]})["edge"] for k in ("assertion", "meeting"))
    assert got.columns == want.columns and [t for _, t in got.dtypes] == [t for _, t in want.dtypes]
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and got.count() > 150
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(subject#\d+L, dealt", plan) and "Window" not in plan and "explode(objects" not in plan


def test_recall_deals_rows_once_by_question(spark, sf, monkeypatch):
    """tasks of a bounded number of rows, and no second deal by question and key."""
    monkeypatch.setattr("fablespark.plans.ops_queries.TASK_ROWS", 1000)
    plan = entry.queries()["recall_mrr"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert set(re.findall(r"hashpartitioning\((q#\d+L, \d+)\), REPARTITION_BY_NUM", plan)) and "ENSURE_REQUIREMENTS" not in plan.replace("SinglePartition, ENSURE_REQUIREMENTS", "")


def test_ingestion_order_does_not_matter(spark, novel, tmp_path):
    a = ingest.ingest(spark, {"document": novel}, f"file://{tmp_path}/a")
    b = ingest.ingest(spark, {"document": novel.orderBy(F.desc("book_order"))}, f"file://{tmp_path}/b")
    assert stores.checksum(a["character"]).first() == stores.checksum(b["character"]).first()


def test_mentions_of_all_languages_against_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    chars = {c for r in rows for c in r["text"] or ""}
    big, small = ("".join(re.escape(c) for c in chars if unicodedata.category(c) == k) for k in ("Lu", "Ll"))
    letter = "".join(re.escape(c) for c in chars if unicodedata.category(c)[0] == "L")
    titles = "|".join(h.capitalize() for h in HONORIFICS)
    pattern = re.compile(rf"(?:^|[^{letter}])((?:(?:{titles})\.? )?[{big}][{small}]+(?: [{big}][{small}]+)*)")
    want = Counter((r["doc_id"], m) for r in rows for m in pattern.findall(r["text"] or "") if m.lower() not in characters.NOT_NAMES)
    assert {(r["doc_id"], r["surface_form"]): r["n"] for r in entry.queries()["mention_discovery"](spark, sf).collect()} == want


def test_embedding_only_what_is_missing(spark):
    chunk = spark.createDataFrame([("a", "one"), ("b", "two")], "chunk_id string, text string")
    once = ingest.embed_chunks({"chunk": chunk.limit(1)})["vector"]
    both = ingest.embed_chunks({"chunk": chunk, "vector": once})["vector"].collect()
    assert sorted(r["chunk_id"] for r in both) == ["a", "b"]
    assert all(abs(sum(x * x for x in r["vector"]) - 1) < 1e-9 for r in both)


def test_templates_are_closed(spark):
    edges = spark.createDataFrame([(1, "friend_of", 2, 0.5, 1, [1])], "subject int, predicate string, object int, confidence double, evidence_count int, page_refs array<int>")
    assert ask.run_template(spark, "relations_by_predicate", edges, character=2, predicate="friend_of").count() == 1
    for name, slots in [("drop_table", {}), ("relations_of", {}), ("relations_by_predicate", {"character": 1, "predicate": "x' OR 1=1"})]:
        with pytest.raises(ValueError):
            ask.run_template(spark, name, edges, **slots)


def test_ask_abstains_and_interrupts(spark):
    a = spark.createDataFrame([(1, 1, 1, "friend_of", 2, "narrated", 0.5, 2, 1, 7)], "assertion_id long, chunk_id long, subject long, predicate string, object long, assertion_type string, confidence double, book_order int, chapter int, page int")
    people = spark.createDataFrame([(1, "Kei", []), (2, "Mary", []), (3, "Mary", [])], "character_id long, canonical_name string, aliases array<string>")
    late = ask.ask(spark, "Is Kei a friend of anyone?", people, a, 2, 1).collect()
    assert [e["type"] for e in late] == ["route", "citation", "done"] and json.loads(late[1]["payload"])["page_refs"] == [7]
    early = ask.ask(spark, "Is Kei a friend of anyone?", people, a, 1, 9).collect()
    assert json.loads(early[-1]["payload"])["abstained"] is True and all(e["type"] != "citation" for e in early)
    tied = ask.ask(spark, "Is Mary a friend?", people, a, 2, 1)
    assert [e["type"] for e in tied.collect()] == ["route", "interrupt", "done"]
    assert [tuple(r) for r in ask.resume(tied, {"Mary": 3}).collect()] == [("Mary", 3)] and ask.resume(tied, {"Mary": 1}).count() == 0


def test_retry_once_then_raise():
    answers = iter(["not json", '{"a": 1}'])
    assert models.structured_call(lambda _: next(answers), "p", ("a",)) == ({"a": 1}, 2)
    with pytest.raises(ValueError):
        models.structured_call(lambda _: "{}", "p", ("a",))
    assert models.route_model("answer", {"answer": "big"}, "local", private=True) == "local" and models.context_length(None) == 40960


def test_uploads_manifest_and_object_store(spark, tmp_path):
    old = stores.with_content_hash(spark.createDataFrame([(1, "p", b"x")], "id int, project_id string, content binary"))
    new = stores.with_content_hash(spark.createDataFrame([(2, "p", b"x"), (3, "p", b"y"), (4, "p", b"y"), (5, "q", b"x")], "id int, project_id string, content binary"))
    assert sorted(r["id"] for r in stores.new_uploads(new, old).collect()) == [3, 5]
    files = new.filter("id = 3").withColumn("name", F.lit("f"))
    good = files.select("name", F.col("content_hash").alias("sha256"), F.lit(1).alias("series_order"))
    assert stores.checked_manifest(files.select("name", "content_hash"), good).count() == 1
    with pytest.raises(Exception, match="checksum mismatch"):
        stores.checked_manifest(files.select("name", "content_hash"), good.withColumn("sha256", F.lit("0"))).collect()
    s = stores.ObjectStore(spark, f"file://{tmp_path}/s")
    s.put("a/b", b"bytes\x00\xff")
    assert s.get("a/b") == b"bytes\x00\xff" and s.exists("a/b") and s.delete_prefix("a") and not s.exists("a/b")


def test_partitions_are_replaced_not_doubled(spark, tmp_path):
    df = spark.createDataFrame([("a", "b1"), ("b", "b2")], "id string, book_id string")
    for _ in range(2):
        stores.replace_partitions(df.filter("book_id = 'b1'"), f"file://{tmp_path}", "t")
        stores.replace_partitions(df.filter("book_id = 'b2'"), f"file://{tmp_path}", "t")
    assert spark.read.parquet(f"file://{tmp_path}/t").count() == 2


def test_a_book_without_rows_leaves_no_stale_partition(spark, tmp_path):
    df = spark.createDataFrame([("a", "b1"), ("b", "b 2"), ("c", "b3")], "id string, book_id string")
    stores.replace_partitions(df, f"file://{tmp_path}", "t")
    stores.replace_partitions(df.filter("book_id = 'b1'"), f"file://{tmp_path}", "t", covers=["b1", "b 2", "never there"])
    assert sorted(r["book_id"] for r in spark.read.parquet(f"file://{tmp_path}/t").collect()) == ["b1", "b3"]


def test_policy_as_of_over_units_of_time(spark):
    policies = spark.createDataFrame([("x", 5, 1), ("x", 2_500_000, 2), ("y", 7, 3)], "purpose string, at long, version int")
    asked = spark.createDataFrame([(i, p, at) for i, (p, at) in enumerate([("x", 4), ("x", 5), ("x", 999_999), ("x", 1_700_000), ("x", 2_499_999), ("x", 2_500_000), ("x", 9_000_000), ("y", 6), ("y", 8_000_000), ("z", 1), ("x", None)])], "i int, purpose string, at long")
    got = {r["i"]: r["policy_version"] for r in ops.policy_at(asked, policies, "purpose", "at").collect()}
    assert [got[i] for i in range(11)] == [None, 1, 1, 1, 1, 2, 2, None, 3, None, None]


def test_b_cubed_by_hand(spark):
    rows = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "a", "y"), (4, "b", "y")], "i int, p string, g string")
    r = evals.b_cubed(rows, "p", "g").first()
    assert abs(r["precision"] - (2 / 3 + 2 / 3 + 1 / 3 + 1) / 4) < 1e-12 and abs(r["recall"] - (1 + 1 + 0.5 + 0.5) / 4) < 1e-12


def test_isotonic_is_monotone(spark):
    c = spark.createDataFrame([(0, 10, 0.1), (1, 10, 0.5), (2, 10, 0.3), (3, 10, 0.9)], "bin int, n long, accuracy double")
    got = [r["calibrated"] for r in evals.isotonic_bins(c).orderBy("bin").collect()]
    assert got == [0.1, 0.4, 0.4, 0.9]


def test_platt_scaling_recovers_a_sigmoid(spark):
    rows = spark.range(40_000).selectExpr("id % 101 / 100.0 AS c", "rand(4) < 1 / (1 + exp(-(6 * (id % 101 / 100.0) - 4))) AS ok")
    slope, offset = evals.platt_scaling(rows, "c", "ok")
    assert abs(slope - 6) < 0.3 and abs(offset + 4) < 0.2
    got = rows.select(evals.platt_calibrated(F.col("c"), (slope, offset)).alias("p"), F.col("ok").cast("double").alias("y")).agg(F.avg("p"), F.avg("y")).first()
    assert abs(got[0] - got[1]) < 0.01
    assert evals.platt_scaling(rows.limit(0), "c", "ok") == (0.0, 0.0)


def test_gold_labels_are_pinned_to_their_corpus(spark, tmp_path):
    manifest = spark.createDataFrame([("b.txt", "2"), ("a.txt", "1")], "name string, sha256 string")
    digest = gold.manifest_checksum(manifest)
    assert digest == gold.manifest_checksum(manifest.orderBy("name"))
    line = {"book": "a", "canonical_name": "Kei", "aliases": ["K"], "importance_tier": "major", "first_page": 3, "manifest_sha256": digest}
    (tmp_path / "roster.json").write_text(json.dumps(line) + "\n")
    rows = gold.load_gold(spark, f"file://{tmp_path}/roster.json", "roster", manifest)
    assert sorted(tuple(r) for r in gold.alias_map(rows).collect()) == [("a", "K", "Kei"), ("a", "Kei", "Kei")]
    with pytest.raises(Exception, match="another corpus"):
        gold.load_gold(spark, f"file://{tmp_path}/roster.json", "roster", manifest.limit(1)).collect()
    (tmp_path / "bad.json").write_text("{not json\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        gold.load_gold(spark, f"file://{tmp_path}/bad.json", "roster").collect()
    with pytest.raises(ValueError, match="unknown kind"):
        gold.load_gold(spark, "x", "nope")


def test_first_resolution_wins(spark):
    r = spark.createDataFrame([(1, 5, 2, "merge"), (1, 4, 9, "keep"), (1, 4, 3, "split")], "task_id int, resolved_at int, resolution_id int, outcome string")
    assert ops.first_resolution(r).first()["outcome"] == "split"


def test_grounding_drops_unbacked_claims(spark):
    claims = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "question_id int, claim_id string")
    got = {r["question_id"]: (r["n_grounded"], r["n_dropped"], r["abstained"]) for r in retrieval.ground(claims, spark.createDataFrame([("a",), ("a",)], "claim_id string")).collect()}
    assert got == {1: (1, 1, False), 2: (0, 1, True)}


def test_null_vectors_are_never_hits(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.5, 0.5])], "vec_id int, embedding array<double>")
    assert [r["vec_id"] for r in retrieval.vector_top(v, [1.0, 0.0], 5).collect()] == [1, 3]


def test_stream_matches_batch_and_late_books_recompute(spark, sf, tmp_path):
    from fablespark.plans import ops_queries
    from fablespark.plans.domain import Domain

    got = ops_queries.stream_spend(Domain(spark, sf)).collect()
    batch = spark.read.parquet(f"{sf}/events.parquet").groupBy(F.to_date("ts").alias("day"), F.col("event_type").alias("stage")).agg(F.round(F.sum("value"), 4).alias("spend")).collect()
    want = {(r["day"], r["stage"]): r["spend"] for r in batch}
    assert got and all(want[r["day"], r["stage"]] == r["spend"] for r in got)
    seen = []
    spark.createDataFrame([(1, "x")], "book_order int, text string").write.parquet(f"file://{tmp_path}/books")
    stream = spark.readStream.schema("book_order int, text string").parquet(f"file://{tmp_path}/books")
    streams.on_late_books(stream, lambda batch: seen.append(batch.count()), f"file://{tmp_path}/cp")
    assert sum(seen) == 1


def test_a_repeated_run_of_a_stream_adds_nothing(spark, tmp_path):
    events = spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, id) AS ts, 'x' AS stage, 1.0D AS cost FROM range(9)")
    events.write.parquet(f"file://{tmp_path}/in")
    for _ in range(2):
        stream = spark.readStream.schema(events.schema).parquet(f"file://{tmp_path}/in")
        out = streams.run_available(streams.tumbling_spend(stream), f"file://{tmp_path}/out", f"file://{tmp_path}/cp")
        assert sorted((str(r["start"])[:10], r["n"]) for r in out.collect()) == [(f"2024-01-0{i}", 1) for i in range(1, 7)]


def test_pending_and_expired_threads(spark):
    tasks = spark.createDataFrame([(1,), (2,)], "task_id int")
    assert [r[0] for r in streams.pending_threads(tasks, tasks.filter("task_id = 1")).collect()] == [2]
    t = spark.sql("SELECT 1 AS id, timestamp'2024-01-01 00:00:00' AS updated_at UNION ALL SELECT 2, timestamp'2024-01-02 12:00:00'")
    assert [r["id"] for r in streams.expired(t, "2024-01-02 13:00:00").collect()] == [1]
