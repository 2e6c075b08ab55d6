import functools
import itertools
import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import __spark_entry__ as entry
from fablespark.operators import characters as ch
from fablespark.operators.components import connected_components

MENTION = "mention_id long, character_id int, surface_form string, book_order int, chapter int, page int"


def test_first_spelling_stays_and_aliases_unite_in_order(spark):
    found = spark.createDataFrame([(1, 1, "Kei", ["K", "Kei-san"], False), (1, 2, "KEI", ["K", "Boss"], True), (1, 3, "Nagare", [], False)], "book int, at int, name string, aliases array<string>, has_appeared_earlier boolean")
    rows = ch.merge_roster(found, ["book"], "at").orderBy("roster_no").collect()
    assert [(r["name"], r["aliases"], r["has_appeared_earlier"]) for r in rows] == [("Kei", ["K", "Kei-san", "Boss"], True), ("Nagare", [], False)]


def test_merge_and_split_restore_the_partition(spark):
    m = spark.createDataFrame([(i, i % 4, f"f{i % 3}", 1, 1, i) for i in range(20)], MENTION)
    merged = ch.merge_characters(m, spark.createDataFrame([(1, 0), (2, 0)], "source_id int, target_id int"))
    assert {r[0] for r in merged.select("character_id").distinct().collect()} == {0, 3}
    twice = ch.merge_characters(merged, spark.createDataFrame([(0, 3)], "source_id int, target_id int"))
    assert ch.undo_merge(twice).select(*m.columns).exceptAll(m).count() == 0
    ids = m.filter("mention_id < 2").select("mention_id")
    assert ch.split_character(m, ids, 77).filter("character_id = 77").count() == 2


def test_merged_edges_lose_loops(spark):
    e = spark.createDataFrame([(1, 2), (1, 3), (2, 3)], "subject int, object int")
    out = ch.merge_edges(e, spark.createDataFrame([(2, 1)], "source_id int, target_id int"))
    assert sorted((r["subject"], r["object"]) for r in out.collect()) == [(1, 3), (1, 3)]


def test_two_of_one_name_in_a_scene_stay_apart(spark):
    names = spark.createDataFrame([(1, i, n) for i, n in enumerate(["Catherine", "Mr. Hareton", "Hareton", "catherine", "Cathy"])], "project_id int, node int, name string")
    free = {r["node"]: r["cluster"] for r in ch.cluster_aliases(names).collect()}
    assert free == {0: 0, 1: 1, 2: 1, 3: 0, 4: 0}
    apart = {r["node"]: r["cluster"] for r in ch.cluster_aliases(names, spark.createDataFrame([(0, 3)], "u int, v int")).collect()}
    assert apart[0] != apart[3] and apart[1] == apart[2] == 1


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_fuzzy_names_against_brute_force(spark):
    rnd = random.Random(3)
    names = sorted({"".join(rnd.choice("abc") for _ in range(rnd.randint(1, 7))) for _ in range(120)})
    asked = sorted({"".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 8))) for _ in range(80)} - set(names))
    people = spark.createDataFrame(list(enumerate(names)), "character_id int, canonical_name string").withColumn("aliases", F.array().cast("array<string>"))
    got = {(r["query"], r["character_id"]) for r in ch.resolve_names(spark.createDataFrame([(x,) for x in asked], "query string"), people).collect() if r["method"] == "fuzzy"}
    assert got == {(x, i) for x in asked for i, n in enumerate(names) if edits(x, n) <= 2}
    assert any(x[0] != names[i][0] for x, i in got)


def test_whole_table_queries_against_brute_force(spark, sf):
    found = entry.queries()
    customers = [(r["c_custkey"], r["c_name"]) for r in spark.read.parquet(f"{sf}/customer.parquet").collect()]
    got = {(r["query"], r["character_id"], r["method"]) for r in found["name_resolution"](spark, sf).collect()}
    form = lambda k, n: n if k % 3 == 0 else n[1:] if k % 3 == 1 else n[:2] + n[3] + n[2] + n[4:]
    want = set()
    for k, n in customers:
        x = form(k, n)
        want |= {(x, k, "exact")} if x == n else {(x, c, "fuzzy") for c, m in customers if edits(x.lower(), m.lower()) <= 2}
    assert got == want and len({x for x, _, m in got if m == "fuzzy"}) == sum(k % 3 > 0 for k, _ in customers)
    scenes = {}
    for r in spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_suppkey").collect():
        scenes.setdefault((r[0], r[1] % 2), set()).add(r[2])
    pairs = {p for x in scenes.values() for p in itertools.combinations(sorted(x), 2)}
    assert pairs and pairs == {(r["u"], r["v"]) for r in found["cannot_links"](spark, sf).collect() if r["reason"] == "co_presence"}


def test_resolution_shows_ties(spark):
    people = spark.createDataFrame([(1, "Elizabeth Bennet", ["Lizzy"]), (2, "Elizabeth Gardiner", []), (3, "Mary", []), (4, "Mary", [])], "character_id int, canonical_name string, aliases array<string>")
    q = spark.createDataFrame([("elizabeth bennet",), ("Lizzy",), ("Lizzy Bennet",), ("Mary",), ("Elizabet Gardiner",), ("Nobody",)], "query string")
    got = {}
    for r in ch.resolve_names(q, people).collect():
        got.setdefault(r["query"], set()).add((r["character_id"], r["method"]))
    assert got == {"elizabeth bennet": {(1, "exact")}, "Lizzy": {(1, "alias")}, "Lizzy Bennet": {(1, "nickname")}, "Mary": {(3, "exact"), (4, "exact")}, "Elizabet Gardiner": {(2, "fuzzy")}}


def test_death_blocks_a_link(spark):
    cand = spark.createDataFrame([(0, "b2|kei", "Kei", []), (0, "b2|new", "Hirai", [])], "project_id int, cluster_key string, name string, aliases array<string>")
    people = spark.createDataFrame([(0, 1, "KEI", [])], "project_id int, character_id int, canonical_name string, aliases array<string>")
    free = {r["cluster_key"]: (r["character_id"], r["method"]) for r in ch.reconcile(cand, people).collect()}
    assert free == {"b2|kei": (1, "normalised"), "b2|new": (None, None)}
    blocked = spark.createDataFrame([("b2|kei", 1, "death")], "cluster_key string, character_id int, reason string")
    got = {r["cluster_key"]: (r["created_new"], r["blocked_by"]) for r in ch.reconcile(cand, people, blocked).collect()}
    assert got == {"b2|kei": (True, "death"), "b2|new": (True, None)}


def test_long_chain_is_one_component(spark):
    nodes = spark.range(0, 60).select(F.col("id").alias("node"))
    links = spark.range(0, 49).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    got = {r["node"]: r["cluster"] for r in connected_components(nodes, links).collect()}
    assert got == {i: 0 if i < 50 else i for i in range(60)}


def test_rejected_candidates_are_kept_with_reasons(spark):
    c = spark.createDataFrame([("Kei", 5), ("London", 9), ("He", 3), ("Bo", 1)], "surface_form string, n int")
    kept, refused = ch.split_rejected(c, spark.createDataFrame([("london",)], "word string"), 2)
    assert [r[0] for r in kept.collect()] == ["Kei"]
    assert {r["surface_form"]: r["reason"] for r in refused.collect()} == {"London": "known_thing", "He": "pronoun", "Bo": "too_few_mentions"}


def test_tiers_and_roster_order(spark):
    rows = spark.createDataFrame([(i, 1, f"n{i}", i) for i in range(101)], "character_id int, project_id int, canonical_name string, mention_count int")
    t = ch.importance_tiers(rows, ["project_id"])
    counts = {r["importance_tier"]: r["count"] for r in t.groupBy("importance_tier").count().collect()}
    assert counts == {"protagonist": 3, "major": 8, "minor": 30, "mentioned": 60}
    assert ch.roster(t).first()["character_id"] == 100


def test_merge_prompt_and_aliases(spark):
    c = spark.createDataFrame([(1, "Kei", ["K"]), (2, "Kay", ["KK"])], "character_id int, canonical_name string, aliases array<string>")
    r = ch.merge_aliases(c, spark.createDataFrame([(2, 1)], "source_id int, target_id int")).collect()
    assert [(x["character_id"], x["canonical_name"], x["aliases"], x["human_verified"]) for x in r] == [(1, "Kei", ["K", "KK", "Kay"], True)]
    b = spark.createDataFrame([([], [], ["t1", "t2"])], "known_names array<string>, previous_texts array<string>, texts array<string>")
    assert "no names" in ch.extraction_prompts(b).first()["prompt"]


def test_embedding_stage_takes_what_is_left(spark):
    from fablespark.functions.text import hashed_vector

    people = spark.createDataFrame([(1, "Elizabeth Bennet", []), (2, "Mary Bennet", []), (3, "Jane Fairfax", [])], "character_id long, canonical_name string, aliases array<string>")
    asked = spark.createDataFrame([("Elizabeth Anne Bennet",), ("Elizabeth Bennet",), ("Nobody Known",)], "query string")
    plain = {(r["query"], r["character_id"], r["method"]) for r in ch.resolve_names(asked, people).collect()}
    assert plain == {("Elizabeth Bennet", 1, "exact")}
    full = {(r["query"], r["character_id"], r["method"]) for r in ch.resolve_names(asked, people, encoder=lambda c: hashed_vector(c, 256)).collect()}
    assert full == plain | {("Elizabeth Anne Bennet", 1, "embedding")}


def test_two_generations_are_kept_apart(spark):
    names = spark.createDataFrame([(1, "Catherine Linton"), (2, "young Catherine Linton"), (3, "Catherine Linton the elder"), (4, "Catherine Linton Jr."), (5, "Old Tom"), (6, None)], "node long, name string")
    assert {(r["u"], r["v"]) for r in ch.generation_links(names).collect()} == {(2, 3), (3, 4)}
    none = spark.createDataFrame([], "node long, scene_id long, key string")
    kin, spans = spark.createDataFrame([], "u long, v long"), spark.createDataFrame([], "node long, key string, first_at int, last_at int")
    assert {r["reason"] for r in ch.cannot_links(none, kin, spans, names).collect()} == {"generation"}


def test_death_blocks_a_match(spark):
    found = spark.createDataFrame([(1, "a", "Tom Hale", 5, 5, 1), (1, "b", "Tom Hale", 5, 2, 1)], "project_id int, cluster_key string, name string, mention_count int, first_book_order int, first_chapter int")
    people = spark.createDataFrame([(1, 7, "Captain Tom Hale", "major", 2, 9)], "project_id int, character_id int, canonical_name string, importance_tier string, died_book_order int, died_chapter int")
    assert [tuple(r) for r in ch.cross_book_blocks(found, people).collect()] == [("a", 7, "death")]


def test_exploded_names_are_never_broadcast(spark):
    people = spark.range(9).selectExpr("id character_id", "concat('Person ', 100 + id * 11) canonical_name", "array('Shade') aliases")
    found = ch.resolve_names(spark.sql("SELECT 'Prson 100' query"), people)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [variant" in plan and "BroadcastHashJoin" not in plan
    assert [tuple(r) for r in found.collect()] == [("Prson 100", 0, "fuzzy", 1)]


def test_clusters_of_nodes_with_one_key_need_no_rounds(spark):
    """the last stage's key holds those of all stages; the same clusters as by following the links of all."""
    forms = ["Mr. Bill Ash", "ash, WILLIAM", "William Ash", "Lizzy Ash", "Dr. Elizabeth Ash", "mr san", "Mr. San-San", "san", "Mr", "...", "", None, "Kei", "KEI san", "Will Ash sama"]
    names = spark.createDataFrame([(i, p, n) for i, (p, n) in enumerate((p, n) for p in (1, 2, None) for n in forms)], "node int, project_id int, name string")
    want = connected_components(names.select("node"), functools.reduce(DataFrame.unionByName, ch._key_links(names)))
    often = names.unionByName(names.withColumn("name", F.upper("name")))
    found = ch.with_clusters(often, "node", "project_id", "name", "key", "cluster")
    got = sorted(set(map(tuple, found.select("node", "cluster").collect())))
    assert got == sorted(map(tuple, want.collect())) == sorted(map(tuple, ch.cluster_aliases(names).collect()))
    assert sum(a != b for a, b in got) >= 12 and "Join" not in found._jdf.queryExecution().toString()
