"""Explicit schemas and value sets of the domain tables, and their quality checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tables and columns of the data contract.
TABLES = {
    "project": "id string, name string, slug string, kind string, roster_version int",
    "book": "id string, project_id string, series_order int, title string, author string, translator string, content_hash string, storage_key string, page_count int, chapter_count int, status string",
    "chapter": "id string, book_id string, number int, title string, heading_text string, page_start int, page_end int, detection_method string, confidence double",
    "chunk": "id string, book_id string, chapter_id string, text string, headings array<string>, pages array<int>, page_start int, page_end int, token_count int, text_embedding array<float>, tokens array<string>",
    "character": "id string, project_id string, canonical_name string, aliases array<string>, importance_tier string, first_book_id string, first_chapter int, first_page int, last_book_id string, last_chapter int, mention_count int, attributes map<string,string>, collision_suspected boolean, human_verified boolean",
    "appearance": "id string, character_id string, book_id string, first_page int, first_chapter int, last_page int, last_chapter int, mention_count int, importance_tier string, surface_forms array<string>, attributes map<string,string>",
    "mention": "id string, character_id string, book_id string, chunk_id string, surface_form string, page int, char_start int, char_end int, confidence double, resolution_method string, n int, origin_character_id string",
    "candidate": "id string, book_id string, surface_form string, cluster_key string, kind string, contexts array<string>, mention_count int, resolved_character_id string",
    "rejected": "id string, book_id string, surface_form string, kind string, reason string, contexts array<string>, human_verified boolean",
    "relation": "id string, project_id string, subject_character_id string, object_character_id string, predicate string, family string, confidence double, status string, assertion_type string, asserted_by_character_id string, hearsay boolean, first_book_order int, first_chapter int, last_book_order int, last_chapter int, evidence_count int, human_verified boolean, page_refs array<int>",
    "evidence": "id string, relation_id string, book_id string, chunk_id string, book_order int, chapter_no int, page_start int, page_end int, quote string, assertion_type string, confidence double",
    "review_task": "id string, project_id string, book_id string, task_type string, payload string, graph_thread_id string, priority int, status string, resolution string, resolved_at timestamp_ntz, resolved_by string",
    "correction": "id string, project_id string, review_task_id string, task_type string, model_value string, human_value string, model_confidence double, resolution_method string, evidence string",
    "run": "id string, book_id string, trace_url string, started_at timestamp_ntz, finished_at timestamp_ntz",
    "stage": "id string, run_id string, stage string, state string, attempt int, started_at timestamp_ntz, finished_at timestamp_ntz, duration_ms int, rows_written int, input_tokens int, output_tokens int, cost_usd double, error_class string, error_message string, traceback string",
    "query_log": "id string, project_id string, question string, route string, template string, retrieved_ids string, answer string, citations string, model_used string, policy_version string, input_tokens int, output_tokens int, cost_usd double, latency_ms string, limit_book_order int, limit_chapter int",
    "eval_run": "id string, config string, corpus_version string, git_sha string, metrics string, notes string",
}
# The value sets of the enumerated columns.
VALUES = {
    ("project", "kind"): ("standalone", "series"),
    ("book", "status"): ("queued", "processing", "ready", "failed"),
    ("stage", "state"): ("pending", "running", "succeeded", "failed", "skipped"),
    ("chapter", "detection_method"): ("regex", "llm", "manual"),
    ("character", "importance_tier"): ("protagonist", "major", "minor", "mentioned"),
    ("candidate", "kind"): ("person", "place", "organisation", "unknown"),
    ("mention", "resolution_method"): ("exact", "normalised", "honorific", "nickname", "embedding", "llm", "human"),
    ("relation", "family"): ("kinship", "romantic", "social", "adversarial", "structural"),
    ("relation", "assertion_type"): ("narrated", "dialogue", "inferred"),
    ("relation", "status"): ("active", "ended", "superseded"),
    ("review_task", "task_type"): ("merge_characters", "merge_across_books", "confirm_relation", "resolve_conflict", "classify_candidate", "confirm_chapter_split"),
    ("review_task", "status"): ("open", "resolved", "dismissed"),
}
PURPOSES = ("chapter_classify", "character_extract", "relation_extract", "adjudicate", "answer", "judge")
ROUTES = ("character_lookup", "relationship_lookup", "path", "aggregation", "series_arc", "narrative", "ambiguous")
STAGES = (
    "pipeline.parse_and_chunk", "pipeline.segment_chapters", "pipeline.embed_chunks", "pipeline.extract_characters", "pipeline.resolve_aliases",
    "pipeline.reconcile_characters", "relations.extract", "relations.aggregate", "graph.upsert",
)
QUOTE_MAX = 400
#: Largest page of a list by what it lists.
PAGE_LIMITS = {"chunks": 500, "mentions": 500, "evidence": 200, "search": 100, "review": 200, "runs": 200}


def checks(table: str) -> dict[str, Column]:
    """The rules that each row of a table must meet, by name."""
    c = F.col
    own = {
        "chunk": {"pages": (F.size("pages") >= 1) & (c("page_start") == F.array_min("pages")) & (c("page_end") == F.array_max("pages")), "page_range": (c("page_start") >= 1) & (c("page_end") >= c("page_start"))},
        "evidence": {"page_range": (c("page_start") >= 1) & (c("page_end") >= c("page_start")), "quote": F.length("quote") <= QUOTE_MAX, "confidence": c("confidence").between(0, 1)},
        "relation": {"no_loop": c("subject_character_id") != c("object_character_id"), "evidence": c("evidence_count") >= 1, "confidence": c("confidence").between(0, 1)},
    }.get(table, {})
    return own | {f"{col}_value": c(col).isNull() | c(col).isin(*vals) for (t, col), vals in VALUES.items() if t == table}


def split_valid(df: DataFrame, table: str) -> tuple[DataFrame, DataFrame]:
    """Rows that meet all checks, and the others with the names of those they fail."""
    failed = F.filter(F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in checks(table).items()]), lambda x: x.isNotNull())
    marked = df.withColumn("failed_checks", failed)
    return marked.filter(F.size("failed_checks") == 0).drop("failed_checks"), marked.filter(F.size("failed_checks") > 0)


def paged(df: DataFrame, what: str, limit: int, offset: int = 0) -> DataFrame:
    """A page of an ordered frame, its size held to the limit of its kind."""
    return df.offset(max(0, offset)).limit(max(0, min(limit, PAGE_LIMITS[what])))
