"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

Texts are lower-cased runs of letters and digits. An item's set is its distinct
five-word shingles. Items are partitioned by the size of their set (powers of
two); each partition has a signature length of floor((1 - t) * u) + 1 for its
upper size u and the containment t asked for, and an item's signature is that
many of its least shingle hashes (a bottom-k MinHash sketch; the whole set, if
it is smaller). A document that holds a share t of an item's shingles misses at
most floor((1 - t) * size) of them, so it holds one of the signature: the
search through the signatures loses nothing, however long the document is and
however small its Jaccard similarity to the item. Candidates are then verified
by the exact containment of the shingles themselves, not of hashes.

Items of fewer than five words are one shingle of all their words, looked for
among the documents' shingles of that many words.

Documents are read once to probe the signatures, without a shuffle of texts,
and the candidates' texts once more. Broadcasts happen only behind a count:
signatures up to ``BROADCAST_ROWS`` rows, items up to ``BROADCAST_CHARS``
characters, candidate pairs up to ``BROADCAST_ROWS``; beyond these the same
joins shuffle.

Cases: null and wordless texts and rows with a null id match nothing; repeated
documents or items come back once an id (the greatest containment; each text of
an item has a signature of its own, however often it stands); of two
items with one text both are found; very long documents are read whole; empty
tables give an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fablespark.llm.common import checkpointed, free_prefix

WIDTH = 5
THRESHOLD = 0.8
BROADCAST_ROWS = 400_000
BROADCAST_CHARS = 8_000_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _shingles(words: Column, width: Column) -> Column:
    """Distinct shingles of ``width`` words, space-joined; none if there are fewer words."""
    at = F.when(F.size(words) >= width, F.sequence(F.lit(1), F.size(words) - width + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.array_join(F.slice(words, i, width), " ")))


def _hash_at(hashes: Column, i: Column, width: int) -> Column:
    """One hash of ``width`` consecutive word hashes from position i (from 0)."""
    return F.xxhash64(*[F.get(hashes, i + j) for j in range(width)])


def item_sets(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """(item_id, width, shingles, n): each item's distinct shingles, in order, and how many.

    Rows that repeat an item's set are one; other texts under one id are entries of their own.
    """
    w = items.filter("item_id is not null").select("item_id", words_of(F.col("text")).alias("words")).filter(F.size("words") > 0)
    sized = w.withColumn("width", F.least(F.size("words"), F.lit(width)))
    return sized.select("item_id", "width", F.array_sort(_shingles(F.col("words"), F.col("width"))).alias("shingles")).distinct().withColumn("n", F.size("shingles"))


def signatures(sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(width, hash, item_id): each item's least hashes, as many as its size partition asks for."""
    # The documents' hashes are made of word hashes; so are these.
    entries = sets.withColumn("entry", F.monotonically_increasing_id())  # one an item and set, each with a quota of its own
    by_words = entries.select("entry", "item_id", "width", "n", F.posexplode("shingles").alias("at", "shingle")).withColumn("h", F.transform(F.split("shingle", " "), lambda w: F.xxhash64(w)))
    one = F.lit(None).cast("long")
    for k in range(1, WIDTH + 1):
        one = F.when(F.col("width") == k, _hash_at(F.col("h"), F.lit(0), k)).otherwise(one)
    upper = F.pow(F.lit(2.0), F.ceil(F.log2(F.col("n").cast("double"))))
    length = F.floor(F.lit(1 - threshold) * upper + F.lit(1e-9)) + 1
    ranked = by_words.select("entry", "item_id", "width", length.alias("length"), one.alias("hash")).withColumn("rank", F.row_number().over(Window.partitionBy("entry").orderBy("hash")))
    return ranked.filter("rank <= length").select("width", "hash", "item_id").distinct()


def candidate_pairs(docs: DataFrame, signs: DataFrame, widths: list[int], small: bool) -> DataFrame:
    """Distinct (doc_id, item_id) of documents that hold a signature hash of the item; one pass over the texts for all widths."""
    hashes = docs.filter("doc_id is not null").select("doc_id", F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)).alias("h")).filter(F.size("h") > 0)
    at = hashes.select("doc_id", "h", F.explode(F.sequence(F.lit(0), F.size("h") - 1)).alias("i"))
    each = [F.struct(F.lit(w).alias("width"), F.when(F.col("i") + w <= F.size("h"), _hash_at(F.col("h"), F.col("i"), w)).alias("hash")) for w in widths]
    probe = at.select("doc_id", *([each[0].alias("p")] if len(each) == 1 else [F.explode(F.array(*each)).alias("p")])).select("doc_id", "p.width", "p.hash")
    return probe.join(F.broadcast(signs) if small else signs, ["width", "hash"]).select("doc_id", "item_id").distinct()


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, n_shared, n_shingles, containment) of all pairs from ``threshold`` on."""
    sets = checkpointed(item_sets(items))
    signs = checkpointed(signatures(sets, threshold))
    widths = [r[0] for r in signs.select("width").distinct().orderBy("width").collect()]  # WIDTH values at most
    if not widths:
        return docs.limit(0).crossJoin(items.limit(0).select("item_id")).select("doc_id", "item_id", F.lit(0).alias("n_shared"), F.lit(0).alias("n_shingles"), F.lit(0.0).alias("containment"))
    small_signs = signs.count() <= BROADCAST_ROWS
    small_sets = (sets.agg(F.sum(F.aggregate("shingles", F.lit(0).cast("long"), lambda a, s: a + F.length(s)))).first()[0] or 0) <= BROADCAST_CHARS
    pairs = checkpointed(candidate_pairs(docs, signs, widths, small_signs))
    few = pairs.count() <= BROADCAST_ROWS
    # Each candidate document's shingles are made once, before its items are attached.
    by_doc = pairs.groupBy("doc_id").agg(F.collect_set("item_id").alias("items"))  # bounded by the number of items
    texts = docs.select("doc_id", "text").join(F.broadcast(by_doc) if few else by_doc, "doc_id")
    own = texts.select("doc_id", "items", words_of(F.col("text")).alias("words"))
    made = own.select("doc_id", "items", *[_shingles(F.col("words"), F.lit(w)).alias(f"s{w}") for w in widths])
    each = made.select("doc_id", F.explode("items").alias("item_id"), *[f"s{w}" for w in widths])
    held = F.coalesce(*[F.when(F.col("width") == w, F.col(f"s{w}")) for w in widths])
    joined = each.join(F.broadcast(sets) if small_sets else sets, "item_id")
    counted = joined.select("doc_id", "item_id", F.size(F.array_intersect("shingles", held)).alias("n_shared"), F.col("n").alias("n_shingles"))
    kept = counted.withColumn("containment", F.col("n_shared") / F.col("n_shingles")).filter(F.col("containment") >= threshold)
    return kept.groupBy("doc_id", "item_id").agg(F.max(F.struct("containment", "n_shared", "n_shingles")).alias("x")).select("doc_id", "item_id", "x.n_shared", "x.n_shingles", "x.containment")


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that hold no item; rows with a null doc_id stay."""
    leak = free_prefix(docs) + "leak"
    found = checkpointed(contaminated(docs, items, threshold).select(F.col("doc_id").alias(leak)).distinct())
    found = F.broadcast(found) if found.count() <= BROADCAST_ROWS else found
    return docs.join(found, docs["doc_id"] == found[leak], "left_anti")


ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '') AS words FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
i AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '') AS words FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
iw AS (SELECT item_id, words, least(len(words), {WIDTH}) AS width FROM i WHERE len(words) > 0),
ishingles AS (SELECT DISTINCT item_id, width, array_to_string(words[k:k + width - 1], ' ') AS shingle FROM iw, range(1, len(words) - width + 2) AS r(k)),
sizes AS (SELECT item_id, count(*) AS n FROM ishingles GROUP BY item_id),
dshingles AS (SELECT DISTINCT doc_id, width, array_to_string(words[k:k + width - 1], ' ') AS shingle FROM d, (SELECT DISTINCT width FROM iw) AS x(width), range(1, len(words) - width + 2) AS r(k)),
shared AS (SELECT doc_id, item_id, count(*) AS m FROM dshingles JOIN ishingles USING (width, shingle) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, CAST(m AS INTEGER) AS n_shared, CAST(n AS INTEGER) AS n_shingles, m / n AS containment FROM shared JOIN sizes USING (item_id) WHERE m / n >= {THRESHOLD}
"""
