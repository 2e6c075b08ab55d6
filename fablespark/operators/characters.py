"""Mentions, rosters, aliases, clusters and cross-book identity."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fablespark.functions.position import position
from fablespark.functions.text import HONORIFICS, bare_name, cosine, family_name_key, formal_name, generation, normal_name
from fablespark.operators.components import connected_components
from fablespark.operators.pairs import pairs_within

# Words that begin sentences or stand for persons but name none.
NOT_NAMES = ("the", "a", "an", "he", "she", "it", "they", "we", "you", "i", "his", "her", "this", "that", "of", "and", "but", "in", "on", "at", "to", "as", "by", "for", "with", "from", "is", "was")


def mentions(chunks: DataFrame, chunk: str = "chunk_id", text: str = "text") -> DataFrame:
    """(chunk, surface_form, n): capitalised runs and honorific forms, once a form with its count."""
    titles = "|".join(h.capitalize() for h in HONORIFICS)
    pattern = rf"(?:^|[^\p{{L}}])((?:(?:{titles})\.? )?\p{{Lu}}\p{{Ll}}+(?: \p{{Lu}}\p{{Ll}}+)*)"
    forms = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    # Outer, as a filter for texts without any would read each text once more; the nulls go with the words that are no names.
    rows = chunks.select(chunk, F.explode_outer(forms).alias("surface_form")).filter(~F.lower("surface_form").isin(*NOT_NAMES))
    return rows.groupBy(chunk, "surface_form").agg(F.count("*").alias("n"))


def split_rejected(candidates: DataFrame, place_words: DataFrame, min_mentions: int = 1) -> tuple[DataFrame, DataFrame]:
    """Candidates that stay, and those refused with a reason; none is lost.

    ``place_words`` (word) is a gazetteer of things that are no persons.
    """
    known = place_words.select(F.lower("word").alias("_word")).distinct()
    marked = candidates.join(known, F.lower("surface_form") == F.col("_word"), "left")
    reason = F.when(F.col("_word").isNotNull(), "known_thing").when(F.lower("surface_form").isin(*NOT_NAMES), "pronoun").when(F.col("n") < min_mentions, "too_few_mentions")
    marked = marked.withColumn("reason", reason).drop("_word")
    return marked.filter("reason is null").drop("reason"), marked.filter("reason is not null")


def merge_roster(found: DataFrame, project: list[str], at: str) -> DataFrame:
    """Characters found batch by batch as one roster: case-insensitive names.

    The first spelling stays, aliases are united in order, ``has_appeared_earlier``
    holds if it did once. ``roster_no`` is the order of first appearance.
    """
    key = F.lower("name")
    merged = found.groupBy(*project, key.alias("key")).agg(
        F.min_by("name", at).alias("name"),
        F.min(at).alias("first_at"),
        F.array_distinct(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct(F.col(at).alias("at"), "aliases"))), lambda x: x["aliases"]))).alias("aliases"),
        F.bool_or("has_appeared_earlier").alias("has_appeared_earlier"),
    )
    return merged.withColumn("roster_no", F.row_number().over(Window.partitionBy(*project).orderBy("first_at")))


def appearances(mention_rows: DataFrame) -> DataFrame:
    """One row a character and book: first and last page and chapter, mentions, surface forms."""
    return mention_rows.groupBy("character_id", "book_order").agg(
        F.min("page").alias("first_page"),
        F.min("chapter").alias("first_chapter"),
        F.max("page").alias("last_page"),
        F.max("chapter").alias("last_chapter"),
        F.count("*").alias("mention_count"),
        F.sort_array(F.collect_set("surface_form")).alias("surface_forms"),
    )


def recompute_characters(appearance_rows: DataFrame) -> DataFrame:
    """Derived fields of each character from all its appearances; the order they came in doesn't matter."""
    first, last = F.struct("book_order", F.coalesce("first_chapter", F.lit(0)).alias("c"), "first_page"), F.struct("book_order", F.coalesce("last_chapter", F.lit(0)).alias("c"), "last_page")
    return (
        appearance_rows.groupBy("character_id")
        .agg(F.min(first).alias("f"), F.max(last).alias("l"), F.sum("mention_count").alias("mention_count"), F.sort_array(F.collect_set("book_order")).alias("appears_in_books"))
        .select("character_id", F.col("f.book_order").alias("first_book_order"), F.col("f.c").alias("first_chapter"), F.col("f.first_page").alias("first_page"), F.col("l.book_order").alias("last_book_order"), F.col("l.c").alias("last_chapter"), "mention_count", "appears_in_books")
    )


def mention_histogram(mention_rows: DataFrame) -> DataFrame:
    """(character_id, chapters map<int,long>): mentions by chapter."""
    counts = mention_rows.groupBy("character_id", F.coalesce("chapter", F.lit(0)).alias("chapter")).agg(F.count("*").alias("n"))
    return counts.groupBy("character_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("chapter", "n")))).alias("chapters"))


def alias_counts(mention_rows: DataFrame, method: str | None = None) -> DataFrame:
    """(character_id, surface_form, n, ambiguous): ambiguous forms name more than one character.

    ``method`` names a column with how a mention was resolved; the most frequent
    one of each form (ties: the last by name) is then added as resolution_method.
    """
    if method is None:
        by_form = mention_rows.groupBy("character_id", "surface_form").agg(F.count("*").alias("n"))
    else:
        each = mention_rows.groupBy("character_id", "surface_form", F.col(method).alias("_m")).agg(F.count("*").alias("_n"))
        by_form = each.groupBy("character_id", "surface_form").agg(F.sum("_n").alias("n"), F.max(F.struct("_n", "_m"))["_m"].alias("resolution_method"))
    owners = by_form.groupBy("surface_form").agg((F.count("*") > 1).alias("ambiguous"))
    return by_form.join(owners, "surface_form").select("character_id", "surface_form", "n", "ambiguous", *(["resolution_method"] if method else []))


def new_in_book(appearance_rows: DataFrame, book_order: int) -> DataFrame:
    """Characters whose first appearance is that book."""
    return appearance_rows.groupBy("character_id").agg(F.min("book_order").alias("first_book_order")).filter(F.col("first_book_order") == book_order)


def importance_tiers(characters: DataFrame, project: list[str], cuts: tuple[float, float, float] = (0.98, 0.90, 0.60)) -> DataFrame:
    """Adds pct (share of the roster with fewer mentions) and importance_tier.

    Ranks come from counts of equal mention numbers, not from a sort of the whole
    roster, so a large project is no single task: just its distinct mention
    numbers are ordered.
    """
    levels = characters.groupBy(*project, "mention_count").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*project)
    below = F.coalesce(F.sum("_n").over(w.orderBy("mention_count").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("_n").over(w)
    ranked = levels.withColumn("pct", F.when(total > 1, below / (total - 1)).otherwise(F.lit(0.0))).drop("_n")
    tier = F.when(F.col("pct") >= cuts[0], "protagonist").when(F.col("pct") >= cuts[1], "major").when(F.col("pct") >= cuts[2], "minor").otherwise("mentioned")
    return characters.join(ranked, [*project, "mention_count"]).withColumn("importance_tier", tier)


def composite_tiers(characters: DataFrame, project: list[str]) -> DataFrame:
    """Tiers by scenes, dialogue lines and chapters together (the sum of their shares of the project's greatest)."""
    most = characters.groupBy(*project).agg(*[F.greatest(F.max(c), F.lit(1)).alias(f"_{c}") for c in ("scenes", "dialogue_lines", "chapters")])
    scored = characters.join(most, project).withColumn("weight", sum((F.col(c) / F.col(f"_{c}") for c in ("scenes", "dialogue_lines", "chapters")), F.lit(0.0)) / 3)
    tier = F.when(F.col("weight") >= 0.66, "protagonist").when(F.col("weight") >= 0.33, "major").when(F.col("weight") >= 0.1, "minor").otherwise("mentioned")
    return scored.withColumn("importance_tier", tier).drop("_scenes", "_dialogue_lines", "_chapters")


TIER_ORDER = ("protagonist", "major", "minor", "mentioned")


def tier_rank(tier: Column) -> Column:
    out = F.lit(len(TIER_ORDER))
    for i, t in enumerate(TIER_ORDER):
        out = F.when(tier == t, i).otherwise(out)
    return out


def _roster_order(sort: str) -> list[Column]:
    order = {"mentions": F.desc("mention_count"), "first_page": F.asc_nulls_last("first_page"), "name": F.asc("canonical_name")}[sort]
    return [tier_rank(F.col("importance_tier")), order, F.col("character_id")]


def roster(characters: DataFrame, sort: str = "mentions") -> DataFrame:
    """Grouped by tier, protagonists first, then by mentions, first page or name."""
    return characters.orderBy(*_roster_order(sort))


def roster_numbers(characters: DataFrame, project: list[str], sort: str = "mentions") -> DataFrame:
    """roster_no: each character's place in its project's roster."""
    return characters.withColumn("roster_no", F.row_number().over(Window.partitionBy(*project).orderBy(*_roster_order(sort))))


def search_characters(characters: DataFrame, query: str) -> DataFrame:
    """Characters whose name or an alias holds the query, case folded."""
    q = F.lower(F.lit(query))
    return characters.filter(F.contains(F.lower("canonical_name"), q) | F.exists("aliases", lambda a: F.contains(F.lower(a), q)))


def top_contexts(mention_rows: DataFrame, n: int) -> DataFrame:
    """The first n mention contexts of each character in reading order."""
    w = Window.partitionBy("character_id").orderBy(position(F.col("book_order"), F.col("chapter")), "page", "mention_id")
    return mention_rows.withColumn("context_no", F.row_number().over(w)).filter(F.col("context_no") <= n)


def cited_attributes(attributes: DataFrame) -> DataFrame:
    """Attributes stay only with a page that shows them."""
    return attributes.filter("page is not null")


def deletion_variants(name: Column, max_edits: int) -> Column:
    """The name and what is left of it without up to ``max_edits`` of its letters.

    Two names within that many edits have a variant in common.
    """
    places = lambda x: F.when(F.length(x) > 0, F.sequence(F.lit(1), F.length(x))).otherwise(F.array().cast("array<int>"))
    shorter = lambda x: F.transform(places(x), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))
    level = out = F.array(name)
    for _ in range(max_edits):
        level = F.array_distinct(F.flatten(F.transform(level, shorter)))
        out = F.array_union(out, level)
    return out


def resolve_names(queries: DataFrame, characters: DataFrame, max_edits: int = 2, encoder: Callable[[Column], Column] | None = None, least_cosine: float = 0.75) -> DataFrame:
    """(query, character_id, method, rank): the cheapest stage that hits, ties shown.

    Stages are exact name, alias, nickname, then edit distance. The fuzzy stage
    takes the queries that no earlier one hits, and compares those pairs of
    normalised names that have a deletion variant in common, which loses none.
    With an ``encoder`` (text to vector) what is still left is compared by cosine
    with the names that have a word in common; the nearest count.
    Names, and what they are exploded into, are merged: Spark rates an exploded
    table by the size of its source, and would send all variants through the driver.
    """
    q = queries.select("query", normal_name(F.col("query")).alias("k"), formal_name(F.col("query")).alias("f"))
    names = characters.select("character_id", normal_name(F.col("canonical_name")).alias("k"), formal_name(F.col("canonical_name")).alias("f"))
    aliases = characters.select("character_id", F.explode("aliases").alias("alias")).select("character_id", normal_name(F.col("alias")).alias("k"))
    stage = lambda df, m, p: df.select("query", "character_id", F.lit(m).alias("method"), F.lit(p).alias("priority"))
    merged = lambda a, b, *on: a.hint("merge").join(b, *on)
    hits = stage(merged(q, names, "k"), "exact", 1).unionByName(stage(merged(q, aliases, "k"), "alias", 2)).unionByName(stage(merged(q, names, "f"), "nickname", 3))
    rest = merged(q, hits.select("query").distinct(), "query", "left_anti").select("query", "k").distinct()
    variants = lambda df, k: df.withColumn("variant", F.explode(deletion_variants(F.col(k), max_edits)))
    named = names.select("character_id", F.col("k").alias("nk"))
    fuzzy = merged(variants(rest, "k"), variants(named, "nk"), "variant").filter(F.levenshtein("k", "nk") <= max_edits)
    hits = hits.unionByName(stage(fuzzy, "fuzzy", 4))
    if encoder is not None:
        left = merged(rest, fuzzy.select("query").distinct(), "query", "left_anti")
        words = lambda df, k: df.withColumn("word", F.explode(F.array_distinct(F.split(F.col(k), " ")))).filter("word <> ''")
        met = merged(words(left, "k"), words(named, "nk"), "word").select("query", "k", "character_id", "nk").distinct()
        near = met.withColumn("cosine", F.round(cosine(encoder(F.col("k")), encoder(F.col("nk"))), 9)).filter(F.col("cosine") >= least_cosine)
        most = near.groupBy("query").agg(F.max("cosine").alias("cosine"))
        hits = hits.unionByName(stage(near.join(most, ["query", "cosine"]), "embedding", 5))
    best = hits.groupBy("query", "character_id").agg(F.min(F.struct("priority", "method")).alias("m"))
    top = best.select("query", "character_id", F.col("m.method").alias("method"), F.dense_rank().over(Window.partitionBy("query").orderBy("m.priority")).alias("rank"))
    return top.filter("rank = 1")


def _key_links(names: DataFrame) -> list[DataFrame]:
    """Links (u, v, method) of each stage: from a name to the least of those with its key."""
    stages = [("normalised", normal_name(F.col("name"))), ("honorific", bare_name(F.col("name"))), ("nickname", formal_name(F.col("name")))]
    out = []
    for method, key in stages:
        keyed = names.select("project_id", "node", key.alias("k")).filter("k <> '' and project_id is not null")
        least = F.min("node").over(Window.partitionBy("project_id", "k"))
        out.append(keyed.select(F.col("node").alias("u"), least.alias("v"), F.lit(method).alias("method")).filter("u <> v"))
    return out


def match_links(names: DataFrame, cannot_link: DataFrame | None = None) -> DataFrame:
    """Links (u, v, method) between names of one project by equal keys, cheapest stage first.

    Each key group is linked to its least member, so a group of n names gives
    n - 1 links. Pairs that must stay apart are left out.
    """
    out, *later = _key_links(names)
    for links in later:
        out = out.unionByName(links.join(out, ["u", "v"], "left_anti"))
    if cannot_link is not None:
        both = cannot_link.select("u", "v").unionByName(cannot_link.select(F.col("v").alias("u"), F.col("u").alias("v")))
        out = out.join(both, ["u", "v"], "left_anti")
    return out


def with_clusters(rows: DataFrame, node: str, project: str, name: str, key: str, out: str) -> DataFrame:
    """Adds the cluster of each row's node as ``cluster_aliases`` finds it, and the key that its nodes share (null: none).

    A node may have many rows, but all in one project and with names that differ in case only. Then its cluster
    is the least node of its last key, and no links are followed.
    """
    keyed = rows.withColumn(key, formal_name(F.col(name))).withColumn(key, F.when((F.col(key) != "") & F.col(project).isNotNull(), F.col(key)))
    least = F.min(node).over(Window.partitionBy(project, key))
    return keyed.withColumn(out, F.when(F.col(key).isNotNull(), least).otherwise(F.col(node)))


def cluster_aliases(names: DataFrame, cannot_link: DataFrame | None = None) -> DataFrame:
    """(node, cluster). A cluster that holds a pair that must stay apart falls back to exact names.

    Names with equal keys of one stage have equal keys of all later ones, as each key is made from the one
    before; so, if nothing must stay apart, the last stage's links join all.
    """
    # How a link was found is of no use here.
    links = _key_links(names)[-1] if cannot_link is None else match_links(names, cannot_link)
    nodes = names.select("node").distinct()
    clusters = connected_components(nodes, links)
    if cannot_link is None:
        return clusters
    a, b = clusters.select(F.col("node").alias("u"), F.col("cluster").alias("cu")), clusters.select(F.col("node").alias("v"), F.col("cluster").alias("cv"))
    bad = cannot_link.join(a, "u").join(b, "v").filter("cu = cv").select(F.col("cu").alias("cluster")).distinct()
    return clusters.join(bad.withColumn("_bad", F.lit(True)), "cluster", "left").select("node", F.when(F.col("_bad"), F.col("node")).otherwise(F.col("cluster")).alias("cluster"))


def cannot_links(mention_rows: DataFrame, kinship: DataFrame, lifespans: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(u, v, reason) of nodes that can't be one character.

    Same scene under two forms of one name; parent and child; lifespans apart;
    namesakes of two generations. ``mention_rows`` (node, scene_id, key),
    ``kinship`` (u, v), ``lifespans`` (node, key, first_at, last_at), ``names``
    (node, name).
    """
    together = pairs_within(mention_rows, ["scene_id", "key"], "node").select("u", "v", F.lit("co_presence").alias("reason"))
    kin = kinship.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), F.lit("kinship").alias("reason"))
    # Spans go along with their nodes, so that the pairs of a key are made block by block.
    spans = lifespans.filter("node is not null").select("key", F.struct("node", "first_at", "last_at").alias("span"))
    apart = pairs_within(spans, ["key"], "span").filter("u.node < v.node and (u.last_at < v.first_at or v.last_at < u.first_at)")
    apart = apart.select("u.node", F.col("v.node").alias("v"), F.lit("lifespan").alias("reason")).withColumnRenamed("node", "u")
    found = together.unionByName(kin).unionByName(apart)
    if names is not None:
        found = found.unionByName(generation_links(names))
    return found.groupBy("u", "v").agg(F.min("reason").alias("reason"))


def generation_links(names: DataFrame) -> DataFrame:
    """(u, v, reason) of nodes (node, name) whose names are alike but for generations that differ."""
    marked = names.select("node", family_name_key(F.col("name")).alias("key"), generation(F.col("name")).alias("kind")).filter("kind is not null and key <> ''").distinct()
    a, b = marked.alias("a"), marked.alias("b")
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.kind") != F.col("b.kind")) & (F.col("a.node") < F.col("b.node")))
    return met.select(F.col("a.node").alias("u"), F.col("b.node").alias("v"), F.lit("generation").alias("reason")).distinct()


def cross_book_blocks(candidates: DataFrame, characters: DataFrame, kinship: DataFrame | None = None) -> DataFrame:
    """(cluster_key, character_id, reason): pairs of like name that must go to review, for ``reconcile``.

    The character died before the candidate first appears; kinship contradicts
    (``kinship`` (cluster_key, character_id): one is told to be a relative of the
    other); the names are of different generations; or a protagonist is matched
    with a name that is mentioned once. The first of these that holds counts.
    ``candidates`` (project_id, cluster_key, name, mention_count, first_book_order,
    first_chapter), ``characters`` (project_id, character_id, canonical_name,
    importance_tier, died_book_order, died_chapter).
    """
    left = candidates.select("project_id", "cluster_key", family_name_key(F.col("name")).alias("k"), generation(F.col("name")).alias("g"), "mention_count", position(F.col("first_book_order"), F.col("first_chapter")).alias("at"))
    right = characters.select("project_id", "character_id", family_name_key(F.col("canonical_name")).alias("k"), generation(F.col("canonical_name")).alias("h"), "importance_tier", F.when(F.col("died_book_order").isNotNull(), position(F.col("died_book_order"), F.col("died_chapter"))).alias("died"))
    met = left.join(right, ["project_id", "k"]).filter("k <> ''")
    if kinship is not None:
        met = met.join(kinship.select("cluster_key", "character_id", F.lit(True).alias("kin")).distinct(), ["cluster_key", "character_id"], "left")
    else:
        met = met.withColumn("kin", F.lit(False))
    reason = (
        F.when(F.col("at") > F.col("died"), "death")
        .when(F.col("kin"), "kinship")
        .when(F.coalesce("g", F.lit("")) != F.coalesce("h", F.lit("")), "namesake")
        .when((F.col("importance_tier") == "protagonist") & (F.col("mention_count") <= 1), "tier")
    )
    return met.select("cluster_key", "character_id", reason.alias("reason")).filter("reason is not null").distinct()


def reconcile(candidates: DataFrame, characters: DataFrame, blocked: DataFrame | None = None) -> DataFrame:
    """Each book cluster's project character, by the first stage of the cascade that hits.

    ``candidates`` (project_id, cluster_key, name, aliases), ``characters``
    (project_id, character_id, canonical_name, aliases), ``blocked``
    (cluster_key, character_id, reason). Returns cluster_key, character_id
    (null: new), created_new, method, confidence, blocked_by.
    """
    forms = lambda df, key, name: df.select("project_id", key, F.explode(F.array_distinct(F.concat(F.array(name), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("form"))
    left, right = forms(candidates, "cluster_key", "name"), forms(characters, "character_id", "canonical_name")
    stages = [("exact", F.col("form"), 1.0), ("normalised", normal_name(F.col("form")), 0.95), ("honorific", bare_name(F.col("form")), 0.85), ("nickname", formal_name(F.col("form")), 0.75)]
    hits = None
    for i, (method, key, confidence) in enumerate(stages):
        h = left.select("project_id", "cluster_key", key.alias("k")).join(right.select("project_id", "character_id", key.alias("k")), ["project_id", "k"]).select("cluster_key", "character_id", F.struct(F.lit(i).alias("stage"), F.lit(method).alias("method"), F.lit(confidence).alias("confidence")).alias("s"))
        hits = h if hits is None else hits.unionByName(h)
    best = hits.groupBy("cluster_key", "character_id").agg(F.min("s").alias("s"))
    if blocked is not None:
        best = best.join(blocked.select("cluster_key", "character_id", F.col("reason").alias("_reason")), ["cluster_key", "character_id"], "left")
    else:
        best = best.withColumn("_reason", F.lit(None).cast("string"))
    pick = best.groupBy("cluster_key").agg(F.min(F.when(F.col("_reason").isNull(), F.struct("s", "character_id"))).alias("p"), F.min("_reason").alias("blocked_by"))
    return candidates.select("cluster_key").distinct().join(pick, "cluster_key", "left").select(
        "cluster_key", F.col("p.character_id").alias("character_id"), F.col("p").isNull().alias("created_new"), F.col("p.s.method").alias("method"), F.coalesce("p.s.confidence", F.lit(0.0)).alias("confidence"), F.when(F.col("p").isNull(), F.col("blocked_by")).alias("blocked_by")
    )


def merge_characters(mention_rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """Mentions re-pointed by (source_id, target_id); where they came from is kept for a later split."""
    m = mapping.select(F.col("source_id").alias("character_id"), "target_id")
    origin = F.coalesce("origin_character_id", "character_id") if "origin_character_id" in mention_rows.columns else F.col("character_id")
    return mention_rows.join(m, "character_id", "left").withColumn("origin_character_id", origin).withColumn("character_id", F.coalesce("target_id", "character_id")).drop("target_id")


def merge_edges(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges re-pointed; those that became loops go."""
    s, o = mapping.select(F.col("source_id").alias("subject"), F.col("target_id").alias("_s")), mapping.select(F.col("source_id").alias("object"), F.col("target_id").alias("_o"))
    moved = edges.join(s, "subject", "left").join(o, "object", "left").withColumn("subject", F.coalesce("_s", "subject")).withColumn("object", F.coalesce("_o", "object")).drop("_s", "_o")
    return moved.filter("subject <> object")


def merge_aliases(characters: DataFrame, mapping: DataFrame) -> DataFrame:
    """(character_id, canonical_name, aliases, human_verified) after a merge: aliases united, marked verified."""
    m = mapping.select(F.col("source_id").alias("character_id"), "target_id")
    rows = characters.join(m, "character_id", "left").withColumn("_to", F.coalesce("target_id", "character_id"))
    grouped = rows.groupBy(F.col("_to").alias("character_id")).agg(
        F.max(F.when(F.col("target_id").isNull(), F.col("canonical_name"))).alias("canonical_name"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.concat("aliases", F.when(F.col("target_id").isNotNull(), F.array("canonical_name")).otherwise(F.array().cast("array<string>"))))))).alias("aliases"),
        F.bool_or(F.col("target_id").isNotNull()).alias("human_verified"),
    )
    return grouped


def split_character(mention_rows: DataFrame, mention_ids: DataFrame, new_id) -> DataFrame:
    """Mentions of the given ids go to a new character; all others stay."""
    ids = mention_ids.select("mention_id").distinct().withColumn("_moved", F.lit(True))
    return mention_rows.join(ids, "mention_id", "left").withColumn("character_id", F.when(F.col("_moved"), F.lit(new_id)).otherwise(F.col("character_id"))).drop("_moved")


def undo_merge(mention_rows: DataFrame) -> DataFrame:
    """Every mention back to the character it came from."""
    return mention_rows.withColumn("character_id", F.coalesce("origin_character_id", "character_id")).drop("origin_character_id")


def extraction_prompts(batches: DataFrame, known: str = "no names", previous: str = "no text") -> DataFrame:
    """prompt from known names, the chunks before and the batch's own texts (arrays)."""
    return batches.withColumn(
        "prompt",
        F.concat(
            F.lit("Names known so far:\n"), F.when(F.size("known_names") > 0, F.array_join(F.array_sort("known_names"), "\n")).otherwise(known),
            F.lit("\n\nText before:\n"), F.when(F.size("previous_texts") > 0, F.array_join("previous_texts", "\n")).otherwise(previous),
            F.lit("\n\nText to read:\n"), F.array_join("texts", "\n---\n"),
        ),
    )


def rule_extractor(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Offline stand-in for the extraction model: names in (book_id, at, text) by capitals."""
    import re

    for f in frames:
        rows = [(b, a, n, [], False) for b, a, t in zip(f["book_id"], f["at"], f["text"], strict=True) for n in dict.fromkeys(re.findall(r"\b[A-Z][a-z]+(?: [A-Z][a-z]+)*", t or "")) if n.lower() not in NOT_NAMES]
        yield pd.DataFrame(rows, columns=["book_id", "at", "name", "aliases", "has_appeared_earlier"])
