"""Questions: route, resolve, fill a template, retrieve, ground, and answer as events.

The reading position is a required argument everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fablespark.functions.position import at_or_before_sql
from fablespark.operators import characters, graph, relations
from fablespark.sources import ontology

# What a question of each route says. The first that fits wins.
ROUTE_PATTERNS = (
    ("series_arc", r"\b(over time|change[sd]?|develop|arc|across the (books|series))\b"),
    ("path", r"\b(connected|connection|path|linked|link between|know each other)\b"),
    ("aggregation", r"\b(how many|list (all|every)|all (the )?characters|which characters|everyone)\b"),
    ("relationship_lookup", r"\b(relationship|related|married|engaged|parent|father|mother|sibling|brother|sister|friend|enemy|rival)\b"),
    ("character_lookup", r"^(who is|who was|tell me about|describe)\b"),
    ("narrative", r"^(what|why|how|when|where)\b"),
)


def route(question: Column) -> Column:
    out = F.lit("ambiguous")
    for name, pattern in reversed(ROUTE_PATTERNS):
        out = F.when(F.lower(F.trim(question)).rlike(pattern), name).otherwise(out)
    return out


#: template id -> (route, SQL with named parameters, slots). No free text ever reaches the engine.
TEMPLATES = {
    "relations_of": ("relationship_lookup", "SELECT subject, predicate, object, confidence, evidence_count, page_refs FROM {edges} WHERE (subject = :character OR object = :character) ORDER BY confidence DESC, subject, predicate, object", ("character",)),
    "relations_by_predicate": ("relationship_lookup", "SELECT subject, predicate, object, confidence, evidence_count, page_refs FROM {edges} WHERE predicate = :predicate AND (subject = :character OR object = :character) ORDER BY confidence DESC, subject, object", ("character", "predicate")),
    "count_by_predicate": ("aggregation", "SELECT predicate, count(*) AS n FROM {edges} GROUP BY predicate ORDER BY predicate", ()),
}


def run_template(spark: SparkSession, template: str, edges: DataFrame, **slots) -> DataFrame:
    """A template with its slots bound; predicates are held against the ontology."""
    if template not in TEMPLATES:
        raise ValueError(f"unknown template: {template}")
    _, sql, names = TEMPLATES[template]
    if set(slots) != set(names):
        raise ValueError(f"{template} takes {names}")
    if "predicate" in slots and slots["predicate"] not in {p[0] for p in ontology.PREDICATES}:
        raise ValueError(f"not in the ontology: {slots['predicate']}")
    return spark.sql(sql, args=slots, edges=edges)


def ask(spark: SparkSession, question: str, names: DataFrame, assertions: DataFrame, limit_book: int, limit_chapter: int | None) -> DataFrame:
    """(seq, type, payload): route, interrupt on tied names, citations, then done.

    ``names`` (character_id, canonical_name, aliases). Edges come from assertions
    up to the position only. Nothing found: an abstention that says so.
    """
    asked = spark.createDataFrame([(question,)], "question string").select("question", route(F.col("question")).alias("route"))
    first = asked.select(F.lit(0).alias("seq"), F.lit("route").alias("type"), F.to_json(F.struct("route")).alias("payload"))
    words = asked.select(F.explode(F.regexp_extract_all(F.regexp_replace("question", r"^(?:Who|What|Why|How|When|Where|Which|Is|Are|Was|Were|Do|Does|Did|Tell)\b", ""), F.lit(r"\p{Lu}\p{Ll}+(?:[ _#]?[\p{Lu}\p{N}][\p{L}\p{N}]*)*"), F.lit(0))).alias("query"))
    hits = characters.resolve_names(words, names)
    per = hits.groupBy("query").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("character_id")).alias("ids"))  # a question's few names
    ties = per.filter("n > 1").select(F.lit(1).alias("seq"), F.lit("interrupt").alias("type"), F.to_json(F.struct("query", "ids")).alias("payload"))
    one = per.filter("n = 1").select(F.col("ids")[0].alias("character_id"))
    edges = graph.edges_at(assertions, limit_book, limit_chapter)
    mine = edges.join(F.broadcast(one.select(F.col("character_id").alias("subject"))), "subject", "left_semi").unionByName(edges.join(F.broadcast(one.select(F.col("character_id").alias("object"))), "object", "left_semi")).distinct()
    # Rounded, so that the order in which evidence was summed decides no tie.
    top = mine.orderBy(F.desc(F.round(F.col("confidence") + F.lit(1e-9), 6)), "subject", "predicate", "object").limit(10)
    cites = top.select(F.lit(2).alias("seq"), F.lit("citation").alias("type"), F.to_json(F.struct("subject", "predicate", "object", "hearsay", "page_refs")).alias("payload"))
    done = top.agg(F.count("*").alias("n")).select(F.lit(3).alias("seq"), F.lit("done").alias("type"), F.to_json(F.struct((F.col("n") == 0).alias("abstained"), F.col("n").alias("citations"))).alias("payload"))
    return first.unionByName(ties).unionByName(cites).unionByName(done).orderBy("seq", "payload")


def resume(events: DataFrame, choice: dict[str, int]) -> DataFrame:
    """Open interrupts with the choice made for them: the id must be one of those offered."""
    offered = events.filter("type = 'interrupt'").select(F.from_json("payload", "query string, ids array<bigint>").alias("p")).select("p.query", "p.ids")
    rows = events.sparkSession.createDataFrame(list(choice.items()) or [("", 0)], "query string, character_id bigint")
    return offered.join(rows, "query").filter(F.array_contains("ids", F.col("character_id"))).select("query", "character_id")


def relationships_known(assertions: DataFrame, character, limit_book: int, limit_chapter: int | None) -> DataFrame:
    """The flagship query: a character's relationships known by a reading position, with pages, inverses included."""
    edges = relations.with_inverses(graph.edges_at(assertions, limit_book, limit_chapter))
    return edges.filter(F.col("subject") == F.lit(character)).orderBy(F.desc("evidence_count"), "predicate", "object")


__all__ = ["TEMPLATES", "ask", "at_or_before_sql", "relationships_known", "resume", "route", "run_template"]
