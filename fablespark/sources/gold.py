"""Gold labels: JSON files by kind, checked and pinned to the manifest they were made for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of each kind; ``manifest_sha256`` names the corpus that the labels hold for.
GOLD = {
    "roster": "book string, canonical_name string, aliases array<string>, importance_tier string, first_page int, manifest_sha256 string",
    "chapter": "book string, number int, title string, page_start int, manifest_sha256 string",
    "relation": "subject string, predicate string, object string, chapters array<int>, evidence_pages array<int>, manifest_sha256 string",
    "identity": "canonical string, appears_in array<int>, surface_forms map<int,array<string>>, manifest_sha256 string",
    "question": "question string, question_class string, expected array<string>, source_pages array<int>, route string, abstain boolean, manifest_sha256 string",
}


def manifest_checksum(manifest: DataFrame) -> str:
    """One digest of a manifest (name, sha256), whatever the order of its few rows."""
    return manifest.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "name", "sha256"))), "\n"), 256)).first()[0]


def load_gold(spark: SparkSession, path: str, kind: str, manifest: DataFrame | None = None) -> DataFrame:
    """The labels of a kind from one JSON object a line; broken lines, or labels for another corpus, fail the job."""
    if kind not in GOLD:
        raise ValueError(f"unknown kind of gold labels: {kind}")
    rows = spark.read.schema(GOLD[kind]).option("mode", "FAILFAST").json(path)
    if manifest is None:
        return rows
    fits = F.coalesce(F.col("manifest_sha256") == manifest_checksum(manifest), F.lit(False))
    return rows.withColumn("manifest_sha256", F.when(fits, F.col("manifest_sha256")).otherwise(F.raise_error(F.lit("gold labels were made for another corpus"))))


def alias_map(roster: DataFrame) -> DataFrame:
    """(book, alias, canonical_name): every form that a gold roster lists, the canonical one too."""
    forms = F.array_distinct(F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>"))))
    return roster.select("book", F.explode(forms).alias("alias"), "canonical_name")
