"""Registered queries over edges, arcs, characters and scenes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fablespark.functions.position import at_or_before_sql
from fablespark.operators import characters, graph, intervals, relations
from fablespark.plans.domain import Domain, query
from fablespark.sources import ontology
from fablespark.sources.stores import checksum

SYMMETRIC = ", ".join(f"'{p[0]}'" for p in ontology.PREDICATES if p[3])
FAMILY = "CASE predicate " + " ".join(f"WHEN '{p[0]}' THEN '{p[1]}'" for p in ontology.PREDICATES) + " END"
CANONICAL = f"""
canonical AS (
  SELECT * EXCLUDE (subject, object, predicate, s, o, swap), CASE WHEN swap THEN o ELSE s END AS subject, CASE WHEN swap THEN s ELSE o END AS object,
         CASE predicate WHEN 'child_of' THEN 'parent_of' WHEN 'ward_of' THEN 'guardian_of' ELSE predicate END AS predicate
  FROM (SELECT *, subject AS s, object AS o, predicate IN ('child_of', 'ward_of') OR (predicate IN ({SYMMETRIC}) AND subject > object) AS swap FROM seen) WHERE subject <> object)"""
EDGES = f"""
grouped AS (
  SELECT subject, predicate, object, {FAMILY} AS family, count(*) AS evidence_count, sum(ln(1 - least(confidence, 0.99))) AS open, bool_and(assertion_type = 'dialogue') AS hearsay,
         min(book_order * 1000 + coalesce(chapter, 0)) AS f, max(book_order * 1000 + coalesce(chapter, 0)) AS l FROM canonical GROUP BY ALL),
edges AS (SELECT subject, predicate, object, family, evidence_count, round(evidence_count / sum(evidence_count) OVER (PARTITION BY subject, object, family) * (1 - exp(open)) + 1e-9, 6) AS confidence, hearsay,
          CAST(f // 1000 AS INT) AS first_book_order, CAST(f % 1000 AS INT) AS first_chapter, CAST(l // 1000 AS INT) AS last_book_order, CAST(l % 1000 AS INT) AS last_chapter FROM grouped)"""
ALL_EDGES = f"WITH seen AS (SELECT * FROM assertion), {CANONICAL}, {EDGES}"
AT = at_or_before_sql("book_order", "chapter", 2, 6)
EDGES_AT = f"WITH seen AS (SELECT * FROM assertion WHERE {AT}), {CANONICAL}, {EDGES}"


def _rounded(name: str) -> Column:
    """Six places; the small addend keeps exact halves from falling either way."""
    return F.round(F.col(name) + F.lit(1e-9), 6)


def _edges(df: DataFrame) -> DataFrame:
    return df.drop("page_refs").withColumn("confidence", _rounded("confidence"))


@query(f"{ALL_EDGES} SELECT * FROM edges")
def edge_aggregate(d: Domain) -> DataFrame:
    return _edges(relations.aggregate_edges(d["assertion"]))


@query(f"WITH seen AS (SELECT * FROM assertion), {CANONICAL} SELECT DISTINCT subject, predicate, object, page FROM canonical")
def edge_page_refs(d: Domain) -> DataFrame:
    return relations.aggregate_edges(d["assertion"]).select("subject", "predicate", "object", F.explode("page_refs").alias("page"))


@query(f"{ALL_EDGES} SELECT subject, predicate, object, evidence_count, false AS derived FROM edges UNION ALL SELECT object, CASE predicate WHEN 'parent_of' THEN 'child_of' ELSE predicate END, subject, evidence_count, true FROM edges")
def edge_inverse_union(d: Domain) -> DataFrame:
    return relations.with_inverses(relations.aggregate_edges(d["assertion"])).select("subject", "predicate", "object", "evidence_count", "derived")


@query(f"WITH seen AS (SELECT * FROM assertion), {CANONICAL} SELECT book_order, chapter, hearsay, count(*) AS n FROM (SELECT subject, predicate, object, book_order, chapter, bool_and(assertion_type = 'dialogue') AS hearsay FROM canonical GROUP BY ALL) GROUP BY ALL")
def edge_hearsay(d: Domain) -> DataFrame:
    """Edges of each chapter, by whether they rest on dialogue alone."""
    edges = relations.aggregate_edges(d["assertion"], keys=("subject", "predicate", "object", "book_order", "chapter"))
    return edges.groupBy("book_order", "chapter", "hearsay").agg(F.count("*").alias("n"))


@query(f"{EDGES_AT} SELECT * FROM edges")
def position_filter(d: Domain) -> DataFrame:
    return _edges(graph.edges_at(d["assertion"], 2, 6))


@query(f"{EDGES_AT}, back AS (SELECT subject AS character_id, predicate, object AS other, evidence_count FROM edges UNION ALL SELECT object, CASE predicate WHEN 'parent_of' THEN 'child_of' ELSE predicate END, subject, evidence_count FROM edges) SELECT * FROM back WHERE character_id = 3")
def relationships_known(d: Domain) -> DataFrame:
    from fablespark.plans.ask import relationships_known as known

    return known(d["assertion"], 3, 2, 6).select(F.col("subject").alias("character_id"), "predicate", F.col("object").alias("other"), "evidence_count")


@query(f"{ALL_EDGES} SELECT e.* FROM edges e WHERE family = 'romantic' AND confidence >= 0.4 AND EXISTS (SELECT 1 FROM canonical c WHERE c.book_order = 3 AND c.subject = e.subject AND c.predicate = e.predicate AND c.object = e.object)")
def graph_book_slice(d: Domain) -> DataFrame:
    edges = relations.aggregate_edges(d["assertion"]).withColumn("confidence", _rounded("confidence"))
    return graph.subgraph(edges, ["romantic"], 0.4, evidence=relations.canonical(d["assertion"]), book_order=3).drop("page_refs")


@query(f"{ALL_EDGES} SELECT subject, predicate, object, true AS truncated FROM edges ORDER BY evidence_count DESC, subject, predicate, object LIMIT 20")
def graph_truncated(d: Domain) -> DataFrame:
    edges = relations.aggregate_edges(d["assertion"]).orderBy(F.desc("evidence_count"), "subject", "predicate", "object")
    return graph.truncated(edges, 20).select("subject", "predicate", "object", "truncated")


@query("WITH both_ways AS (SELECT u, v FROM link UNION SELECT v, u FROM link), one AS (SELECT v AS n FROM both_ways WHERE u = 0), two AS (SELECT DISTINCT b.v AS n FROM both_ways b JOIN one ON b.u = one.n WHERE b.v <> 0) SELECT n AS character_id, min(hops) AS hops FROM (SELECT n, 1 AS hops FROM one UNION ALL SELECT n, 2 FROM two) GROUP BY n")
def neighbourhood_2(d: Domain) -> DataFrame:
    return graph.neighbourhood(d["link"].select(F.col("u").alias("subject"), F.col("v").alias("object")), 0, 2)


@query("""WITH RECURSIVE both_ways AS (SELECT u, v FROM link UNION SELECT v, u FROM link),
walk(node, hops) AS (SELECT CAST(0 AS BIGINT), 0 UNION SELECT b.v, w.hops + 1 FROM walk w JOIN both_ways b ON b.u = w.node WHERE w.hops < 4)
SELECT node, min(hops) AS hops FROM walk GROUP BY node""")
def shortest_path_4(d: Domain) -> DataFrame:
    return graph.hop_counts(d["link"], 0, 4)


def _layers(name: str, first: str, n: int) -> str:
    """Nodes at 1 to n hops of the one node of ``first``, a table each."""
    out = []
    for k in range(1, n + 1):
        before = " AND ".join(f"v NOT IN (SELECT v FROM {name}{j})" for j in range(k))
        out.append(f"{name}{k} AS (SELECT DISTINCT v FROM ways WHERE u IN (SELECT v FROM {name}{k - 1}) AND {before})")
    return f"{name}0 AS ({first}), " + ", ".join(out)


@query(f"""WITH ways AS (SELECT u, v, (u + v) % 100 / 100 AS c FROM link UNION ALL SELECT v, u, (u + v) % 100 / 100 FROM link),
{_layers("out", "SELECT CAST(0 AS BIGINT) AS v", 3)}, {_layers("back", "SELECT min(v) AS v FROM out3", 2)},
p1 AS (SELECT v AS here, [u, v] AS nodes, least(1.0, c) AS worst FROM ways WHERE u = 0 AND v IN (SELECT v FROM back2)),
s2 AS (SELECT v AS here, list_append(nodes, v) AS nodes, least(worst, c) AS worst FROM p1 JOIN ways ON u = here WHERE v IN (SELECT v FROM back1)),
p2 AS (SELECT * FROM s2 QUALIFY row_number() OVER (PARTITION BY here ORDER BY worst DESC, nodes) = 1),
s3 AS (SELECT list_append(nodes, v) AS nodes, least(worst, c) AS worst FROM p2 JOIN ways ON u = here WHERE v IN (SELECT v FROM back0)),
p3 AS (SELECT * FROM s3 QUALIFY row_number() OVER (ORDER BY worst DESC, nodes) = 1)
SELECT CAST(k AS INT) AS hop, nodes[k] AS u, nodes[k + 1] AS v, 'co_occurs_with' AS predicate, (nodes[k] + nodes[k + 1]) % 100 / 100 AS confidence,
       CAST(least(nodes[k], nodes[k + 1]) % 300 + 1 AS VARCHAR) || ',' || CAST(greatest(nodes[k], nodes[k + 1]) % 300 + 1 AS VARCHAR) AS pages FROM p3, range(1, 4) AS r(k)""")
def shortest_path_route(d: Domain) -> DataFrame:
    """The route to one of the nodes three hops off (the least), hop by hop, each with its pages."""
    link = d["link"]
    pages = F.array((F.col("u") % 300 + 1).cast("int"), (F.col("v") % 300 + 1).cast("int"))
    edges = link.select(F.col("u").alias("subject"), F.lit("co_occurs_with").alias("predicate"), F.col("v").alias("object"), ((F.col("u") + F.col("v")) % 100 / 100).alias("confidence"), pages.alias("page_refs"))
    goal = graph.hop_counts(link, 0, 3).filter("hops = 3").agg(F.min("node")).first()[0]
    route = graph.shortest_path(edges, 0, goal if goal is not None else 1, 4)
    return route.select("hop", "u", "v", "predicate", "confidence", F.array_join("page_refs", ",").alias("pages"))


ARCS = f"""
WITH seen AS (SELECT * FROM assertion), {CANONICAL},
at_pos AS (SELECT subject, object, {FAMILY} AS family, book_order, coalesce(chapter, 0) AS chapter, predicate, count(*) AS n FROM canonical GROUP BY ALL),
flags AS (SELECT *, CASE WHEN lag(predicate) OVER w = predicate THEN 0 ELSE 1 END AS new FROM at_pos WINDOW w AS (PARTITION BY subject, object, family ORDER BY book_order, chapter, predicate)),
runs AS (SELECT *, sum(new) OVER (PARTITION BY subject, object, family ORDER BY book_order, chapter, predicate) AS state_no FROM flags),
states AS (SELECT subject, object, family, state_no, predicate, sum(n) AS evidence_count, min(book_order * 1000 + chapter) AS f, max(book_order * 1000 + chapter) AS l FROM runs GROUP BY ALL),
arcs AS (SELECT subject, object, family, CAST(state_no AS BIGINT) AS state_no, predicate, CAST(evidence_count AS BIGINT) AS evidence_count, CAST(f // 1000 AS INT) AS first_book_order, CAST(f % 1000 AS INT) AS first_chapter, CAST(l // 1000 AS INT) AS last_book_order, CAST(l % 1000 AS INT) AS last_chapter,
  lead(predicate) OVER (PARTITION BY subject, object, family ORDER BY state_no) AS next_predicate FROM states),
marked AS (SELECT *, CASE WHEN predicate || '>' || next_predicate IN ({", ".join(f"'{a}>{b}'" for a, b in ontology.TRANSITIONS)}) THEN 'superseded' WHEN next_predicate IS NULL THEN 'active' ELSE 'ended' END AS status FROM arcs)"""


@query("""WITH a AS (SELECT subject, object, predicate, book_order * 100 + chapter AS pos FROM assertion), w AS (SELECT subject, object, predicate, min(pos) AS first_at, max(pos) AS last_at, count(*) AS evidence_count FROM a GROUP BY ALL),
p AS (SELECT DISTINCT subject, object, pos FROM a) SELECT p.subject, p.object, p.pos, w.predicate, w.evidence_count FROM p JOIN w ON p.subject = w.subject AND p.object = w.object AND p.pos BETWEEN w.first_at AND w.last_at""")
def states_at(d: Domain) -> DataFrame:
    """The relations of a pair that hold at each position of the pair; their windows overlap."""
    a = d["assertion"].select("subject", "object", "predicate", (F.col("book_order") * 100 + F.col("chapter")).alias("pos"))
    windows = a.groupBy("subject", "object", "predicate").agg(F.min("pos").alias("first_at"), F.max("pos").alias("last_at"), F.count("*").alias("evidence_count"))
    found = intervals.inside_windows(a.select("subject", "object", "pos").distinct(), windows, ["subject", "object"], "pos")
    return found.select("subject", "object", "pos", "predicate", "evidence_count")


@query(f"{ARCS} SELECT * FROM marked")
def arc_states(d: Domain) -> DataFrame:
    return relations.arcs(d["assertion"])


@query(f"{ARCS} SELECT subject, object, predicate, next_predicate, count(*) AS n FROM marked WHERE status = 'superseded' GROUP BY ALL")
def supersession(d: Domain) -> DataFrame:
    return relations.arcs(d["assertion"]).filter("status = 'superseded'").groupBy("subject", "object", "predicate", "next_predicate").agg(F.count("*").alias("n"))


@query(f"{ALL_EDGES} SELECT object, predicate, 2 AS max_subjects, count(DISTINCT subject) AS n_subjects, 'resolve_conflict' AS task_type FROM edges WHERE predicate = 'parent_of' GROUP BY object, predicate HAVING count(DISTINCT subject) > 2")
def conflict_tasks(d: Domain) -> DataFrame:
    return relations.conflicts(relations.aggregate_edges(d["assertion"]))


@query("""SELECT rejected_because, count(*) AS n FROM (SELECT CASE WHEN subject = object THEN 'self_relation' WHEN subject >= 20 OR object >= 20 THEN 'off_roster' WHEN predicate NOT IN (""" + ", ".join(f"'{p[0]}'" for p in ontology.PREDICATES) + """) THEN 'off_ontology' WHEN NOT contains(p_name, quote) THEN 'fabricated_quote' END AS rejected_because
FROM (SELECT *, CASE WHEN page % 2 = 0 THEN 'widget' ELSE 'ring' END AS quote FROM assertion) JOIN part ON chunk_id = p_partkey) GROUP BY 1""")
def validation(d: Domain) -> DataFrame:
    quoted = d["assertion"].withColumn("quote", F.when(F.col("page") % 2 == 0, "widget").otherwise("ring"))
    known = d["nation"].filter("n_nationkey < 20").select(F.col("n_nationkey").alias("character_id"))
    texts = d["part"].select(F.col("p_partkey").alias("chunk_id"), F.col("p_name").alias("text"))
    return relations.validate(quoted, known, texts).groupBy("rejected_because").agg(F.count("*").alias("n"))


@query(f"WITH seen AS (SELECT * FROM assertion WHERE {AT}), {CANONICAL} SELECT assertion_id, book_order, chapter, page, assertion_type FROM canonical WHERE subject = 1 AND predicate = 'parent_of' AND object = 2 ORDER BY book_order, chapter, page, assertion_id LIMIT 200")
def evidence_list(d: Domain) -> DataFrame:
    return graph.evidence_of(d["assertion"], 1, "parent_of", 2, 2, 6).limit(200).select("assertion_id", "book_order", "chapter", "page", "assertion_type")


APPEARANCES = "appear AS (SELECT character_id, book_order, min(page) AS first_page, min(chapter) AS first_chapter, max(page) AS last_page, max(chapter) AS last_chapter, count(*) AS mention_count, array_to_string(list_sort(list(DISTINCT surface_form)), ',') AS surface_forms FROM mention GROUP BY ALL)"


@query(f"WITH {APPEARANCES} SELECT * FROM appear")
def appearance(d: Domain) -> DataFrame:
    return characters.appearances(d["mention"]).withColumn("surface_forms", F.array_join("surface_forms", ","))


CHARACTERS = "SELECT character_id, CAST(min(book_order * 1000000 + first_chapter * 1000 + first_page) // 1000000 AS INT) AS first_book_order, CAST(min(book_order * 1000000 + first_chapter * 1000 + first_page) // 1000 % 1000 AS INT) AS first_chapter, CAST(min(book_order * 1000000 + first_chapter * 1000 + first_page) % 1000 AS INT) AS first_page, CAST(max(book_order * 1000000 + last_chapter * 1000 + last_page) // 1000000 AS INT) AS last_book_order, CAST(max(book_order * 1000000 + last_chapter * 1000 + last_page) // 1000 % 1000 AS INT) AS last_chapter, CAST(sum(mention_count) AS BIGINT) AS mention_count, array_to_string(list_sort(list(DISTINCT book_order)), ',') AS appears_in_books FROM appear GROUP BY character_id"


def _characters(mention_rows: DataFrame) -> DataFrame:
    return characters.recompute_characters(characters.appearances(mention_rows)).withColumn("appears_in_books", F.array_join("appears_in_books", ","))


@query(f"WITH {APPEARANCES} {CHARACTERS}")
def character_recompute(d: Domain) -> DataFrame:
    return _characters(d["mention"])


@query("SELECT character_id, chapter, count(*) AS n FROM mention GROUP BY ALL")
def mention_histogram(d: Domain) -> DataFrame:
    return characters.mention_histogram(d["mention"]).select("character_id", F.explode("chapters").alias("chapter", "n"))


@query("WITH f AS (SELECT character_id, surface_form, count(*) AS n FROM mention GROUP BY ALL) SELECT *, count(*) OVER (PARTITION BY surface_form) > 1 AS ambiguous FROM f")
def alias_counts(d: Domain) -> DataFrame:
    return characters.alias_counts(d["mention"])


@query("""WITH m AS (SELECT character_id, surface_form, CASE mention_id % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'alias' ELSE 'fuzzy' END AS method, count(*) AS k FROM mention GROUP BY ALL),
f AS (SELECT character_id, surface_form, CAST(sum(k) AS BIGINT) AS n, max({'k': k, 'm': method}).m AS resolution_method FROM m GROUP BY ALL) SELECT *, count(*) OVER (PARTITION BY surface_form) > 1 AS ambiguous FROM f""")
def alias_methods(d: Domain) -> DataFrame:
    way = F.col("mention_id") % 3
    return characters.alias_counts(d["mention"].withColumn("how", F.when(way == 0, "exact").when(way == 1, "alias").otherwise("fuzzy")), "how")


@query(f"""WITH seen AS (SELECT * FROM assertion), {CANONICAL},
new AS (SELECT subject, predicate, object, count(*) AS n FROM canonical GROUP BY ALL), old AS (SELECT subject, predicate, object, count(*) AS m FROM canonical WHERE book_order <= 3 GROUP BY ALL)
SELECT subject, predicate, object, CASE WHEN subject % 5 = 0 AND m IS NOT NULL THEN m ELSE n END AS evidence_count, subject % 5 = 0 AND m IS NOT NULL AS human_verified FROM new LEFT JOIN old USING (subject, predicate, object)""")
def edge_upsert(d: Domain) -> DataFrame:
    """The edges of three books, some verified by a person, after a run over all books."""
    old = relations.aggregate_edges(d["assertion"].filter("book_order <= 3")).withColumn("human_verified", F.col("subject") % 5 == 0)
    after = graph.upsert_edges(old, relations.aggregate_edges(d["assertion"]))
    return after.select("subject", "predicate", "object", "evidence_count", F.coalesce("human_verified", F.lit(False)).alias("human_verified"))


@query("SELECT character_id, min(book_order) AS first_book_order FROM mention GROUP BY character_id HAVING min(book_order) = 2")
def new_in_book(d: Domain) -> DataFrame:
    return characters.new_in_book(characters.appearances(d["mention"]), 2)


@query("SELECT mention_id, character_id, book_order, chapter, page FROM mention WHERE character_id = 1 AND " + at_or_before_sql("book_order", "chapter", 5, 6) + " ORDER BY book_order, chapter, page, mention_id LIMIT 10 OFFSET 5")
def mentions_paged(d: Domain) -> DataFrame:
    from fablespark.sources.schema import paged

    rows = graph.visible(d["mention"].filter("character_id = 1"), 5, 6).orderBy("book_order", "chapter", "page", "mention_id")
    return paged(rows, "mentions", 10, 5).select("mention_id", "character_id", "book_order", "chapter", "page")


TIERS = "tiers AS (SELECT character_id, project_id, canonical_name, mention_count, round(pct, 9) AS pct, CASE WHEN pct >= 0.98 THEN 'protagonist' WHEN pct >= 0.9 THEN 'major' WHEN pct >= 0.6 THEN 'minor' ELSE 'mentioned' END AS importance_tier FROM (SELECT *, percent_rank() OVER (PARTITION BY project_id ORDER BY mention_count) AS pct FROM person))"


def _tiers(d: Domain) -> DataFrame:
    return characters.importance_tiers(d["person"], ["project_id"]).select("character_id", "project_id", "canonical_name", "mention_count", F.round("pct", 9).alias("pct"), "importance_tier")


@query(f"WITH {TIERS} SELECT * FROM tiers")
def tier_percentile(d: Domain) -> DataFrame:
    return _tiers(d)


@query("WITH s AS (SELECT c_custkey AS character_id, c_nationkey AS project_id, CAST(floor(abs(c_acctbal)) AS INT) % 50 AS scenes, CAST(floor(abs(c_acctbal)) AS INT) % 31 AS dialogue_lines, CAST(floor(abs(c_acctbal)) AS INT) % 12 AS chapters FROM customer), m AS (SELECT *, (scenes / greatest(max(scenes) OVER w, 1) + dialogue_lines / greatest(max(dialogue_lines) OVER w, 1) + chapters / greatest(max(chapters) OVER w, 1)) / 3 AS weight FROM s WINDOW w AS (PARTITION BY project_id)) SELECT character_id, CASE WHEN weight >= 0.66 THEN 'protagonist' WHEN weight >= 0.33 THEN 'major' WHEN weight >= 0.1 THEN 'minor' ELSE 'mentioned' END AS importance_tier FROM m")
def tier_composite(d: Domain) -> DataFrame:
    bal = F.abs("c_acctbal")
    n = F.floor(bal).cast("int")
    rows = d["customer"].select(F.col("c_custkey").alias("character_id"), F.col("c_nationkey").alias("project_id"), (n % 50).alias("scenes"), (n % 31).alias("dialogue_lines"), (n % 12).alias("chapters"))
    return characters.composite_tiers(rows, ["project_id"]).select("character_id", "importance_tier")


@query(f"WITH {TIERS} SELECT project_id, character_id, importance_tier, mention_count, CAST(row_number() OVER (PARTITION BY project_id ORDER BY CASE importance_tier WHEN 'protagonist' THEN 0 WHEN 'major' THEN 1 WHEN 'minor' THEN 2 ELSE 3 END, mention_count DESC, character_id) AS INT) AS roster_no FROM tiers")
def roster_sorted(d: Domain) -> DataFrame:
    return characters.roster_numbers(_tiers(d), ["project_id"]).select("project_id", "character_id", "importance_tier", "mention_count", "roster_no")


@query(f"WITH {TIERS} SELECT character_id, importance_tier FROM tiers WHERE importance_tier IN ('protagonist', 'major') OR character_id IN (SELECT character_id FROM mention WHERE book_order = 2 AND chapter = 3)")
def roster_selection(d: Domain) -> DataFrame:
    return relations.select_roster(_tiers(d), d["mention"].filter("book_order = 2 and chapter = 3")).select("character_id", "importance_tier")


@query("SELECT character_id, canonical_name FROM person WHERE lower(canonical_name) LIKE '%0123%' OR lower(segment) LIKE '%0123%'")
def character_search(d: Domain) -> DataFrame:
    return characters.search_characters(d["person"].withColumn("aliases", F.array("segment")), "0123").select("character_id", "canonical_name")


@query("WITH p AS (SELECT DISTINCT scene_id, character_id FROM scene_mention) SELECT a.character_id AS u, b.character_id AS v, count(*) AS weight FROM p a JOIN p b ON a.scene_id = b.scene_id AND a.character_id < b.character_id GROUP BY ALL")
def co_occurs(d: Domain) -> DataFrame:
    return relations.co_occurrence(d["scene_mention"], ["scene_id"])


@query("SELECT scene_id, character_id, count(*) AS n FROM scene_mention GROUP BY ALL")
def scene_participants(d: Domain) -> DataFrame:
    return relations.scene_participants(d["scene_mention"], ["scene_id"])


@query("SELECT event_id, user_id, CAST(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS INT) AS scene_no FROM events")
def scene_islands(d: Domain) -> DataFrame:
    return relations.scene_islands(d["events"], ["user_id"], "event_id", F.col("event_type") == "signup").select("event_id", "user_id", "scene_no")


@query("WITH c AS (SELECT l_orderkey AS chunk_id, count(*) FILTER (l_quantity > 25) AS roster_mentions, count(DISTINCT l_suppkey) AS scene_participants FROM lineitem GROUP BY 1) SELECT * FROM c WHERE roster_mentions >= 2 OR (roster_mentions >= 1 AND scene_participants >= 2)")
def prefilter(d: Domain) -> DataFrame:
    counts = d["lineitem"].groupBy(F.col("l_orderkey").alias("chunk_id")).agg(F.count_if(F.col("l_quantity") > 25).alias("roster_mentions"), F.count_distinct("l_suppkey").alias("scene_participants"))
    return relations.pass_two_candidates(counts)


@query(f"WITH seen AS (SELECT * FROM assertion WHERE book_order <> 3), {CANONICAL}, {EDGES} SELECT * FROM edges")
def book_removal(d: Domain) -> DataFrame:
    left, _ = graph.remove_book(d["assertion"], d["mention"], 3)
    return _edges(relations.aggregate_edges(left))


@query(f"WITH {APPEARANCES.replace('FROM mention', 'FROM (SELECT * FROM mention WHERE book_order <> 3)')} {CHARACTERS}")
def book_removal_characters(d: Domain) -> DataFrame:
    _, left = graph.remove_book(d["assertion"], d["mention"], 3)
    return _characters(left)


@query(f"WITH {APPEARANCES.replace('FROM mention', 'FROM (SELECT * REPLACE (CASE book_order WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE book_order END AS book_order) FROM mention)')} {CHARACTERS}")
def reorder_books(d: Domain) -> DataFrame:
    order = d.spark.createDataFrame([(1, 2), (2, 1)], "book_order int, new_order int")
    return _characters(graph.reorder_books(d["mention"], order))


@query(f"WITH {APPEARANCES.replace('FROM mention', 'FROM (SELECT * REPLACE (CASE WHEN character_id % 10 = 1 THEN character_id - 1 ELSE character_id END AS character_id) FROM mention)')} {CHARACTERS}")
def merge_characters(d: Domain) -> DataFrame:
    mapping = d["customer"].filter("c_custkey % 10 = 1").select(F.col("c_custkey").alias("source_id"), (F.col("c_custkey") - 1).alias("target_id"))
    return _characters(characters.merge_characters(d["mention"], mapping))


@query("SELECT character_id, count(*) AS n FROM (SELECT CASE WHEN mention_id % 3 = 0 AND character_id = 5 THEN -5 ELSE character_id END AS character_id FROM mention) GROUP BY 1")
def split_character(d: Domain) -> DataFrame:
    ids = d["mention"].filter("mention_id % 3 = 0 and character_id = 5").select("mention_id")
    return characters.split_character(d["mention"], ids, -5).groupBy("character_id").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n_rows, true AS restored FROM mention")
def merge_then_split(d: Domain) -> DataFrame:
    mapping = d["customer"].filter("c_custkey % 10 = 1").select(F.col("c_custkey").alias("source_id"), (F.col("c_custkey") - 1).alias("target_id"))
    back = characters.undo_merge(characters.merge_characters(d["mention"], mapping)).select(*d["mention"].columns)
    a, b = checksum(d["mention"]), checksum(back)
    return a.crossJoin(b.select(F.col("checksum").alias("after"))).select(F.col("n").alias("n_rows"), (F.col("checksum") == F.col("after")).alias("restored"))


@query("SELECT true AS same, count(DISTINCT character_id) AS n FROM mention")
def order_independence(d: Domain) -> DataFrame:
    forward = checksum(characters.recompute_characters(characters.appearances(d["mention"])))
    backward = checksum(characters.recompute_characters(characters.appearances(d["mention"].orderBy(F.desc("book_order"), F.desc("mention_id")))))
    return forward.crossJoin(backward.select(F.col("checksum").alias("other"))).select((F.col("checksum") == F.col("other")).alias("same"), "n")


@query(f"{ALL_EDGES} SELECT count(*) AS n, 0 AS without_evidence FROM edges")
def graph_rebuild(d: Domain) -> DataFrame:
    edges = relations.require_evidence(relations.aggregate_edges(d["assertion"]))
    return edges.agg(F.count("*").alias("n"), F.count_if(F.col("evidence_count") < 1).cast("int").alias("without_evidence"))


@query(f"{ALL_EDGES} SELECT subject, predicate, object FROM edges e WHERE EXISTS (SELECT 1 FROM canonical c WHERE c.book_order <> 4 AND c.subject = e.subject AND c.predicate = e.predicate AND c.object = e.object)")
def graph_reset(d: Domain) -> DataFrame:
    return graph.reset_book(relations.aggregate_edges(d["assertion"]), relations.canonical(d["assertion"]), 4).select("subject", "predicate", "object")


@query(f"{ALL_EDGES} SELECT sha256(subject || '|' || predicate || '|' || object) AS id, subject, object FROM edges")
def graph_projection(d: Domain) -> DataFrame:
    people = d["nation"].select(F.col("n_nationkey").alias("character_id"), F.col("n_name").alias("name"))
    return graph.graph_tables(people, relations.aggregate_edges(d["assertion"]))[1].select("id", "subject", "object")
