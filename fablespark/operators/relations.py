"""Assertions to typed edges: canonical form, aggregation, time, conflicts, scenes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fablespark.functions.position import position
from fablespark.operators.pairs import pairs_within
from fablespark.sources import ontology
from fablespark.sources.schema import QUOTE_MAX


def _case(column: Column, pairs: list[tuple], default=None) -> Column:
    out = F.lit(default)
    for k, v in pairs:
        out = F.when(column == k, F.lit(v)).otherwise(out)
    return out


def family(predicate: Column) -> Column:
    """Family of a predicate; the ontology's dozens of rows are constants of the plan."""
    return _case(predicate, [(p[0], p[1]) for p in ontology.PREDICATES])


def canonical(assertions: DataFrame) -> DataFrame:
    """Each fact under one form: inverse predicates turned round, symmetric pairs in order."""
    p = F.col("predicate")
    turned = [(x[0], x[2]) for x in ontology.PREDICATES if x[2] in ontology.STORED]
    inverse = p.isin(*[x[0] for x in turned])
    symmetric = p.isin(*[x[0] for x in ontology.PREDICATES if x[3]])
    swap = inverse | (symmetric & (F.col("subject") > F.col("object")))
    return assertions.withColumns({"subject": F.when(swap, F.col("object")).otherwise(F.col("subject")), "object": F.when(swap, F.col("subject")).otherwise(F.col("object")), "predicate": F.coalesce(_case(p, turned), p)})


def validate(assertions: DataFrame, roster: DataFrame | None = None, texts: DataFrame | None = None) -> DataFrame:
    """Adds ``rejected_because`` (null: valid): self relation, off roster (or no subject or object), off ontology (or no predicate), quote too long or not in its chunk."""
    df = assertions
    off = F.col("subject").isNull() | F.col("object").isNull()
    if roster is not None:
        for side in ("subject", "object"):
            df = df.join(roster.select(F.col("character_id").alias(side)).distinct().withColumn(f"_{side}", F.lit(True)), side, "left")
        off = off | F.col("_subject").isNull() | F.col("_object").isNull()
    fabricated = F.lit(False)
    if texts is not None:
        df = df.join(texts.select("chunk_id", F.col("text").alias("_text")), "chunk_id", "left")
        fabricated = ~F.coalesce(F.contains(F.col("_text"), F.col("quote")), F.lit(False))
    long_quote = F.length("quote") > QUOTE_MAX if "quote" in df.columns else F.lit(False)
    reason = (
        F.when(F.col("subject") == F.col("object"), "self_relation")
        .when(off, "off_roster")
        .when(~F.coalesce(F.col("predicate").isin(*[p[0] for p in ontology.PREDICATES]), F.lit(False)), "off_ontology")
        .when(long_quote, "quote_too_long")
        .when(fabricated, "fabricated_quote")
    )
    return df.withColumn("rejected_because", reason).drop("_subject", "_object", "_text")


def aggregate_edges(assertions: DataFrame, keys: tuple[str, ...] = ("subject", "predicate", "object"), keep_evidence: bool = False, settled: bool = False) -> DataFrame:
    """One edge for all assertions of a fact: evidence count, confidence, hearsay, first and last position, pages.

    Confidence is agreement times one minus the product of what each item
    leaves open; agreement is the predicate's share of the pair's evidence
    within its family. ``keep_evidence`` collects the items as well; without it
    the edge stays small whatever its evidence. ``settled`` says that the
    assertions are in canonical form already; if they are also dealt by some of
    ``keys`` without the predicate, they stay where they are.
    """
    rows = (assertions if settled else canonical(assertions)).filter("subject <> object").withColumn("family", family(F.col("predicate")))
    where = position(F.col("book_order"), F.col("chapter"))
    parts = [
        F.count("*").alias("evidence_count"),
        F.sum(F.ln(1 - F.least("confidence", F.lit(0.99)))).alias("_open"),
        F.bool_and(F.col("assertion_type") == "dialogue").alias("hearsay"),
        F.min(where).alias("_first"),
        F.max(where).alias("_last"),
        F.array_sort(F.collect_set("page")).alias("page_refs"),
    ]
    if keep_evidence:
        parts.append(F.collect_list(F.struct("assertion_id", "book_order", "chapter", "page", "assertion_type", "confidence")).alias("evidence"))
    edges = rows.groupBy(*keys, "family").agg(*parts)
    pair = [k for k in keys if k != "predicate"] + ["family"]
    share = F.col("evidence_count") / F.sum("evidence_count").over(Window.partitionBy(*pair))
    out = edges.withColumn("confidence", share * (1 - F.exp("_open")))
    return out.select(
        *keys, "family", "evidence_count", "confidence", "hearsay", F.col("_first.book_order").alias("first_book_order"), F.col("_first.chapter").alias("first_chapter"), F.col("_last.book_order").alias("last_book_order"), F.col("_last.chapter").alias("last_chapter"), "page_refs", *(["evidence"] if keep_evidence else [])
    )


_NO_BOOK = -(1 << 40)  # sorts before every book, as a null does


def _met(t: pa.Table, confidence: float) -> pa.Table:
    """The pairs of rows (book_order, chapter, page, subject, objects), each once: see ``meeting_edges``."""
    t = t.take(pc.array_sort_indices(t.column("page")))  # the pages of a pair are in order after a stable sort
    column = lambda c, missing=0: pc.fill_null(t.column(c).cast(pa.int64()), missing).to_numpy()
    book, chapter, page, subject = column("book_order", _NO_BOOK), column("chapter"), column("page"), column("subject")
    # A row's place among the positions, and one row for each place.
    order = np.lexsort((chapter, book))
    new = np.append(True, (np.diff(book[order]) != 0) | (np.diff(chapter[order]) != 0))
    at, shown = np.empty(len(order), np.int64), order[new]
    at[order] = np.cumsum(new) - 1
    objects = t.column("objects").combine_chunks()
    row = np.repeat(np.arange(len(t)), pc.list_value_length(objects).to_numpy())
    obj = objects.flatten().to_numpy()
    subjects, place = np.unique(subject, return_inverse=True)
    low, span = int(obj.min()), int(obj.max()) - int(obj.min()) + 1
    if len(subjects) * span < 1 << 62:
        key = place[row] * span + (obj - low)
        order = np.argsort(key, kind="stable")
        same = np.diff(key[order]) == 0
    else:
        order = np.lexsort((obj, place[row]))
        same = (np.diff(obj[order]) == 0) & (np.diff(place[row[order]]) == 0)
    starts = np.flatnonzero(np.append(True, ~same))
    n = np.diff(starts, append=len(order))
    row, obj = row[order], obj[order]
    shows = np.append(True, ~same | (np.diff(page[row]) != 0))
    ends = np.append(0, np.cumsum(np.add.reduceat(shows.astype(np.int64), starts)))
    left = np.cumsum(np.full(n.max(), np.log(1 - min(confidence, 0.99))))  # one by one, as a sum adds it up
    first, last = shown[np.minimum.reduceat(at[row], starts)], shown[np.maximum.reduceat(at[row], starts)]
    books = lambda x: pa.array(book[x], pa.int32(), mask=book[x] == _NO_BOOK, safe=False)
    cols = [subject[row[starts]], obj[starts], n, left[n - 1], books(first), chapter[first].astype(np.int32), books(last), chapter[last].astype(np.int32), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(page[row[shows]], pa.int32()))]
    return pa.table([pa.array(c) for c in cols], names=["subject", "object", "evidence_count", "_open", "first_book_order", "first_chapter", "last_book_order", "last_chapter", "page_refs"])


def meeting_edges(meetings: DataFrame, predicate: str, assertion_type: str, confidence: float) -> DataFrame:
    """``aggregate_edges`` of assertions that still lie together: a row (book_order, chapter, page, subject, objects) holds
    one of each object, all of one predicate, type and confidence, settled. All rows of a pair must be in one partition,
    which a task works on as a whole, without a row an assertion.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if rows:
            yield from _met(pa.Table.from_batches(rows), confidence).to_batches(max_chunksize=20_000)

    kinds = "subject long, object long, evidence_count long, _open double, first_book_order int, first_chapter int, last_book_order int, last_chapter int, page_refs array<int>"
    found = meetings.filter("size(objects) > 0").select("book_order", "chapter", "page", "subject", "objects").mapInArrow(work, kinds)
    return found.select("subject", F.lit(predicate).alias("predicate"), "object", family(F.lit(predicate)).alias("family"), "evidence_count", (1 - F.exp("_open")).alias("confidence"), F.lit(assertion_type == "dialogue").alias("hearsay"), "first_book_order", "first_chapter", "last_book_order", "last_chapter", "page_refs")


def require_evidence(edges: DataFrame) -> DataFrame:
    """Fails the job on an edge without evidence rather than skipping it."""
    return edges.withColumn("evidence_count", F.when(F.col("evidence_count") >= 1, F.col("evidence_count")).otherwise(F.raise_error(F.lit("edge without evidence"))))


def with_inverses(edges: DataFrame) -> DataFrame:
    """Edges and their other direction (inverse or symmetric), marked ``derived``."""
    p = F.col("predicate")
    other = _case(p, [(x[0], x[0] if x[3] else x[2]) for x in ontology.PREDICATES if x[3] or x[2]])
    turned = edges.withColumns({"subject": F.col("object"), "object": F.col("subject"), "predicate": other}).filter("predicate is not null")
    return edges.withColumn("derived", F.lit(False)).unionByName(turned.withColumn("derived", F.lit(True)))


def arcs(assertions: DataFrame) -> DataFrame:
    """States of each pair and family in reading order: one row a run of one predicate.

    Adds when the next state began (``closed_*``), its predicate, whether that is
    a legal transition, and the state's status.
    """
    rows = canonical(assertions).filter("subject <> object").withColumn("family", family(F.col("predicate"))).withColumn("chapter", F.coalesce("chapter", F.lit(0)))
    # One row a predicate and position first: what windows see doesn't grow with repeats.
    at = rows.groupBy("subject", "object", "family", "book_order", "chapter", "predicate").agg(F.count("*").alias("n"))
    pair = ["subject", "object", "family"]
    order = Window.partitionBy(*pair).orderBy("book_order", "chapter", "predicate")
    changed = F.coalesce((F.lag("predicate").over(order) != F.col("predicate")).cast("int"), F.lit(1))
    runs = at.withColumn("_new", changed).withColumn("state_no", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    states = runs.groupBy(*pair, "state_no", "predicate").agg(F.min(F.struct("book_order", "chapter")).alias("f"), F.max(F.struct("book_order", "chapter")).alias("l"), F.sum("n").alias("evidence_count"))
    seq = Window.partitionBy(*pair).orderBy("state_no")
    nxt = F.lead("predicate").over(seq)
    legal = F.coalesce(F.concat_ws(">", "predicate", nxt).isin(*[f"{a}>{b}" for a, b in ontology.TRANSITIONS]), F.lit(False))
    return states.select(
        *pair, "state_no", "predicate", "evidence_count", F.col("f.book_order").alias("first_book_order"), F.col("f.chapter").alias("first_chapter"), F.col("l.book_order").alias("last_book_order"), F.col("l.chapter").alias("last_chapter"),
        nxt.alias("next_predicate"), F.when(legal, "superseded").when(nxt.isNull(), "active").otherwise("ended").alias("status"),
    )


def conflicts(edges: DataFrame) -> DataFrame:
    """Objects with more subjects under a predicate than it allows: tasks for review."""
    limits = [(p[0], p[4]) for p in ontology.PREDICATES if p[4] is not None]
    limited = edges.withColumn("max_subjects", _case(F.col("predicate"), limits).cast("int")).filter("max_subjects is not null")
    return limited.groupBy("object", "predicate", "max_subjects").agg(F.count_distinct("subject").alias("n_subjects")).filter("n_subjects > max_subjects").withColumn("task_type", F.lit("resolve_conflict"))


def scene_islands(chunks: DataFrame, book: list[str], at: str, is_break: Column) -> DataFrame:
    """scene_no: runs of chunks, a new one at each break."""
    w = Window.partitionBy(*book).orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return chunks.withColumn("scene_no", F.sum(F.coalesce(is_break, F.lit(False)).cast("int")).over(w).cast("int"))


def scene_participants(mention_rows: DataFrame, scene: list[str]) -> DataFrame:
    return mention_rows.groupBy(*scene, "character_id").agg(F.count("*").alias("n"))


def co_occurrence(participants: DataFrame, scene: list[str]) -> DataFrame:
    """(u, v, weight): scenes that two characters share. Pairs meet by scene, those of large scenes block by block."""
    return pairs_within(participants, scene, "character_id").groupBy("u", "v").agg(F.count("*").alias("weight"))


def pass_two_candidates(chunks: DataFrame, min_roster_mentions: int = 2) -> DataFrame:
    """Chunks worth the expensive pass: enough roster mentions, or one where the scene has two participants."""
    return chunks.filter((F.col("roster_mentions") >= min_roster_mentions) | ((F.col("roster_mentions") >= 1) & (F.col("scene_participants") >= 2)))


def select_roster(characters: DataFrame, here: DataFrame) -> DataFrame:
    """Leading characters always, lesser ones if they appear here; in a fixed order."""
    seen = here.select("character_id").distinct().withColumn("_here", F.lit(True))
    return characters.join(seen, "character_id", "left").filter(F.col("importance_tier").isin("protagonist", "major") | F.col("_here")).drop("_here").orderBy("canonical_name", "character_id")


_QUOTED = r'["“]([^"”]+)["”]'
_NAME = r"\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)"


def dialogue_lines(chunks: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, line_no, line, tag, narration): quoted speech, the speaker that a tag after it names, and the prose on both sides."""
    pattern = rf"{_QUOTED}(?:[, ]*(?:said|asked|replied|cried|whispered) ({_NAME}?))?"
    line, tag = (F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in (1, 2))
    prose = F.split(text, _QUOTED)
    rows = chunks.select(key, prose.alias("prose"), F.posexplode(F.arrays_zip(line.alias("line"), tag.alias("tag"))).alias("line_no", "z"))
    beside = F.concat_ws(" ", F.get("prose", F.col("line_no")), F.get("prose", F.col("line_no") + 1))
    return rows.select(key, "line_no", F.col("z.line").alias("line"), F.when(F.col("z.tag") != "", F.col("z.tag")).alias("tag"), beside.alias("narration"))


def adjacent_speakers(lines: DataFrame, roster: DataFrame, key: list[str]) -> DataFrame:
    """``lines`` with adjacent: the one name of the roster (name) that the narration beside a line holds; null if it holds none or more."""
    named = lines.select(*key, F.explode(F.array_distinct(F.regexp_extract_all("narration", F.lit(f"({_NAME}*)"), F.lit(1)))).alias("name"))
    only = named.join(roster.select("name").distinct(), "name").groupBy(*key).agg(F.min("name").alias("adjacent"), F.count("*").alias("_n")).filter("_n = 1").drop("_n")
    return lines.join(only, key, "left")


def attribute_speakers(lines: DataFrame, scene: list[str], at: str) -> DataFrame:
    """speaker and how it was found: the tag, else the name beside the line (a column ``adjacent``, if there is one), else alternation in a scene of two speakers, else none."""
    w = Window.partitionBy(*scene)
    beside = F.col("adjacent") if "adjacent" in lines.columns else F.lit(None).cast("string")
    rows = lines.withColumn("_known", F.coalesce(F.col("tag"), beside))
    two = F.size(F.collect_set("_known").over(w)) == 2
    before = F.lag("_known", 2).over(w.orderBy(at))
    method = F.when(F.col("tag").isNotNull(), "tag").when(F.col("_known").isNotNull(), "adjacent").when(two & before.isNotNull(), "alternation").otherwise("unknown")
    return rows.withColumns({"speaker": F.coalesce("_known", F.when(two, before)), "speaker_method": method}).drop("_known")
