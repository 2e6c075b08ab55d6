import pytest
from pyspark.sql import functions as F

from fablespark.operators import characters, graph, relations
from fablespark.sources import ontology, schema, stores

COLS = "assertion_id long, chunk_id long, subject int, predicate string, object int, assertion_type string, confidence double, book_order int, chapter int, page int"


def facts(spark, rows):
    """rows: (subject, predicate, object, book, chapter[, type])."""
    return spark.createDataFrame([(i, i, r[0], r[1], r[2], r[5] if len(r) > 5 else "narrated", 0.5, r[3], r[4], i + 1) for i, r in enumerate(rows)], COLS)


def test_forty_assertions_are_one_edge(spark):
    a = facts(spark, [(1, "friend_of", 2, 1, i) for i in range(20)] + [(2, "friend_of", 1, 1, i) for i in range(20)])
    e = relations.aggregate_edges(a, keep_evidence=True).collect()
    assert len(e) == 1 and e[0]["evidence_count"] == 40 and len(e[0]["evidence"]) == 40 and e[0]["page_refs"] == list(range(1, 41))


def test_inverse_and_symmetric_forms_meet(spark):
    a = facts(spark, [(1, "parent_of", 2, 1, 1), (2, "child_of", 1, 1, 2), (3, "sibling_of", 4, 1, 1), (4, "sibling_of", 3, 2, 1), (5, "unrequited_love_for", 6, 1, 1)])
    e = {(r["subject"], r["predicate"], r["object"]): r["evidence_count"] for r in relations.aggregate_edges(a).collect()}
    assert e == {(1, "parent_of", 2): 2, (3, "sibling_of", 4): 2, (5, "unrequited_love_for", 6): 1}
    both = {(r["subject"], r["predicate"], r["object"]) for r in relations.with_inverses(relations.aggregate_edges(a)).collect()}
    assert both == {*e, (2, "child_of", 1), (4, "sibling_of", 3)}


def test_hearsay_needs_dialogue_alone(spark):
    a = facts(spark, [(1, "friend_of", 2, 1, 1, "dialogue"), (3, "friend_of", 4, 1, 1, "dialogue"), (3, "friend_of", 4, 1, 2)])
    assert {r["subject"]: r["hearsay"] for r in relations.aggregate_edges(a).collect()} == {1: True, 3: False}


def test_an_edge_without_evidence_fails_the_job(spark):
    with pytest.raises(Exception, match="edge without evidence"):
        relations.require_evidence(spark.createDataFrame([(0,)], "evidence_count int")).collect()


def test_three_state_arc(spark):
    a = facts(spark, [(1, "enemy_of", 2, 1, 1), (1, "enemy_of", 2, 1, 9), (2, "rival_of", 1, 2, 3), (1, "rival_of", 2, 2, None)])
    arc = relations.arcs(a).orderBy("state_no").collect()
    assert [(r["predicate"], r["status"], r["first_book_order"], r["first_chapter"]) for r in arc] == [("enemy_of", "superseded", 1, 1), ("rival_of", "active", 2, 0)]


def test_two_fathers_conflict_only_past_the_limit(spark):
    a = facts(spark, [(1, "parent_of", 9, 1, 1), (2, "parent_of", 9, 1, 1), (3, "parent_of", 9, 1, 1), (1, "parent_of", 8, 1, 1), (2, "parent_of", 8, 1, 1)])
    assert [r["object"] for r in relations.conflicts(relations.aggregate_edges(a)).collect()] == [9]


def test_nothing_leaks_past_the_position(spark):
    a = facts(spark, [(1, "friend_of", 2, b, c) for b in (1, 2, 3) for c in (None, 1, 5)])
    for b, c in [(1, None), (1, 1), (2, 0), (3, 4)]:
        e = graph.edges_at(a, b, c).first()
        assert (e["last_book_order"], e["last_chapter"]) <= (b, c or 0)
        assert graph.evidence_of(a, 1, "friend_of", 2, b, c).count() == e["evidence_count"]


def test_removing_the_middle_book_leaves_no_orphans(spark):
    a = facts(spark, [(1, "friend_of", 2, 1, 1), (1, "friend_of", 2, 2, 1), (3, "friend_of", 4, 2, 1), (5, "friend_of", 6, 3, 1)])
    m = spark.createDataFrame([(1, 1, "x", 1, 1, 1), (2, 3, "y", 2, 1, 1), (3, 5, "z", 3, 1, 1), (4, 1, "x", 2, 1, 2)], "mention_id long, character_id int, surface_form string, book_order int, chapter int, page int")
    a2, m2 = graph.remove_book(a, m, 2)
    assert {(r["subject"], r["evidence_count"]) for r in relations.aggregate_edges(a2).collect()} == {(1, 1), (5, 1)}
    assert {r["character_id"] for r in characters.recompute_characters(characters.appearances(m2)).collect()} == {1, 5}
    assert {r["subject"] for r in graph.reset_book(relations.aggregate_edges(a), relations.canonical(a), 2).collect()} == {1, 5}


def test_reverse_ingestion_gives_the_same_rows(spark):
    a = facts(spark, [(i % 5, "friend_of", (i * 3) % 7 + 5, i % 3 + 1, i % 4) for i in range(60)])
    back = a.orderBy(F.desc("assertion_id"))
    x, y = relations.aggregate_edges(a).drop("confidence"), relations.aggregate_edges(back).drop("confidence")
    assert graph.same_rows(x, y) and stores.checksum(x).first() == stores.checksum(y).first()


def test_path_prefers_confidence_then_ids(spark):
    e = [(1, 2, 0.9), (2, 4, 0.2), (1, 3, 0.5), (3, 4, 0.6), (4, 5, 1.0), (6, 7, 1.0)]
    edges = spark.createDataFrame([(a, "friend_of", b, c, [1]) for a, b, c in e], "subject int, predicate string, object int, confidence double, page_refs array<int>")
    assert [(r["u"], r["v"]) for r in graph.shortest_path(edges, 1, 5).collect()] == [(1, 3), (3, 4), (4, 5)]
    assert [(r["u"], r["v"]) for r in graph.shortest_path(edges, 5, 1).collect()] == [(5, 4), (4, 3), (3, 1)]
    assert graph.shortest_path(edges, 1, 7).count() == 0 and graph.shortest_path(edges, 1, 5, max_hops=2).count() == 0


def test_neighbours(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (5, 1)], "subject int, object int")
    assert {(r[0], r[1]) for r in graph.neighbourhood(edges, 1).collect()} == {(2, 1), (5, 1), (3, 2)}
    with pytest.raises(ValueError):
        graph.neighbourhood(edges, 1, 3)


def test_swapping_books(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "book_order int, x string")
    order = spark.createDataFrame([(1, 2), (2, 1)], "book_order int, new_order int")
    assert {(r["x"], r["book_order"]) for r in graph.reorder_books(rows, order).collect()} == {("a", 2), ("b", 1), ("c", 3)}


def test_validation_reasons(spark):
    a = facts(spark, [(1, "friend_of", 1, 1, 1), (1, "friend_of", 99, 1, 1), (1, "hates", 2, 1, 1), (1, "friend_of", 2, 1, 1), (1, "enemy_of", 2, 1, 1)]).withColumn("quote", F.when(F.col("predicate") == "enemy_of", "made up").otherwise("real"))
    roster = spark.createDataFrame([(1,), (2,)], "character_id int")
    texts = spark.createDataFrame([(i, "a real text") for i in range(5)], "chunk_id long, text string")
    got = [r["rejected_because"] for r in relations.validate(a, roster, texts).orderBy("assertion_id").collect()]
    assert got == ["self_relation", "off_roster", "off_ontology", None, "fabricated_quote"]


def test_checks_split_rows(spark):
    rows = spark.createDataFrame([(1, 2, "q", 0.5), (0, 2, "q", 0.5), (1, 2, "q" * 401, 0.5), (2, 1, "q", 1.5)], "page_start int, page_end int, quote string, confidence double")
    good, bad = schema.split_valid(rows.withColumn("assertion_type", F.lit("narrated")), "evidence")
    assert good.count() == 1 and sorted(sum((r["failed_checks"] for r in bad.collect()), [])) == ["confidence", "page_range", "page_range", "quote"]


def test_ontology():
    assert ontology.inverse_of("child_of") == "parent_of" and ontology.inverse_of("sibling_of") == "sibling_of" and ontology.inverse_of("unrequited_love_for") is None
    assert ontology.is_legal_transition("rival_of", "friend_of") and not ontology.is_legal_transition("friend_of", "rival_of")
    assert ontology.family_of("betrayed") == "adversarial" and "co_occurs_with" not in ontology.prompt_fragment()


def test_position_reaches_the_scan_and_columns_are_pruned(spark, tmp_path):
    facts(spark, [(1, "friend_of", 2, 1, 1)]).write.parquet(f"file://{tmp_path}/a")
    plan = graph.edges_at(spark.read.parquet(f"file://{tmp_path}/a"), 2, 6)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(book_order,2)" in plan and "chunk_id" not in plan.split("ReadSchema")[1] and "Python" not in plan


def test_links_between_many_copies_stay_linear(spark):
    """A group of n equal names gives n - 1 links, not all pairs."""
    names = spark.range(500).select(F.lit(1).alias("project_id"), F.col("id").alias("node"), F.lit("Kei").alias("name"))
    assert characters.match_links(names).count() == 499


def test_validation_refuses_nulls(spark):
    rows = spark.createDataFrame([(1, "friend_of", 2), (None, "friend_of", 2), (1, None, 2), (1, "friend_of", None), (1, "friend_of", 9)], "subject int, predicate string, object int")
    roster = spark.createDataFrame([(1,), (2,)], "character_id int")
    for known in (None, roster):
        got = [r["rejected_because"] for r in relations.validate(rows, known).orderBy(F.asc_nulls_last("subject"), F.asc_nulls_last("predicate"), F.asc_nulls_last("object")).collect()]
        assert got == [None, "off_roster" if known is not None else None, "off_roster", "off_ontology", "off_roster"]


def test_upsert_leaves_verified_edges(spark):
    kind = "subject int, predicate string, object int, evidence_count long, human_verified boolean"
    old = spark.createDataFrame([(1, "p", 2, 3, True), (2, "p", 3, 1, False)], kind)
    new = spark.createDataFrame([(1, "p", 2, 9, False), (2, "p", 3, 5, False), (4, "p", 5, 1, False)], kind)
    assert sorted((r["subject"], r["evidence_count"]) for r in graph.upsert_edges(old, new).collect()) == [(1, 3), (2, 5), (4, 1)]
    with pytest.raises(Exception, match="edge without evidence"):
        graph.upsert_edges(old, new.withColumn("evidence_count", F.lit(0).cast("long"))).collect()
