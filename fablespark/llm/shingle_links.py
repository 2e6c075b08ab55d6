"""Near-duplicates at a shingle similarity, for the SimHash stage of the pipeline.

Two bits of 64 reach exact and very close copies only. Texts whose sets of
distinct five-word shingles have a Jaccard similarity of 0.8 differ in about ten
bits, which eight positional bytes can't guarantee to meet, so this search puts
``BYTES`` bytes of MinHash values in their place: of each permutation of the
shingle hashes, one byte of the least value. Two texts of similarity s share a
positional byte with probability s (and one in 256 of the rest).

The inverted index posts a text under windows of consecutive positional bytes.
Pairs that meet must share ``LEAST_SHARED`` of all positional bytes (3.9 standard
deviations below the expectation at 0.8), then reach the threshold on the whole
shingle sets. The search is not exact; the tests hold it against brute force.

Copies and near copies are not expanded into pairs. Each member of a posting list
is compared with the least one of its list. The members of lists of more than
``SHORT`` are posted again under longer windows (``LEVELS``), which tell texts that
share a passage from texts that are alike: where a passage is a share a of n texts, a
list holds n * a^6, then n * a^12, then n * a^20 of them. Lists whose members these links
connect are done. In the short ones that are still open, and in those of the last
level whatever their length, members of different components are compared. So no
list is cut; of texts that are all just under the threshold and not connected,
many still meet at the last level, a number that grows faster than theirs.

Words are those of the SimHash operator. A text of fewer than five words is one
shingle; texts without words have one shingle, the empty one. Documents with
equal shingle sets are one node. Null texts count as empty; rows with a null
doc_id take no part; of a doc_id with several texts each text counts; an empty table
gives no links; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fablespark.llm.common import checkpointed
from fablespark.llm.components import star_components

WIDTH = 5
THRESHOLD = 0.8
BYTES = 320
#: Window and step of the postings, level by level.
LEVELS = ((6, 8), (12, 8), (20, 5))
#: The members of longer lists go to the next level.
SHORT = 32
LEAST_SHARED = 228
#: Tables of two ids a row are broadcast up to this many rows.
BROADCAST_ROWS = 50_000
_SEED = 7
_PART = 512
_KEY = 0x9E3779B97F4A7C15


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    words = text.encode("utf-8", "replace").lower().split() if isinstance(text, str) else []
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), _SEED)], np.uint64)
    digest = xxhash.xxh64_intdigest
    known = {w: digest(w, _SEED) for w in set(words)}
    one = np.fromiter((known[w] for w in words), np.uint64, len(words))
    n = len(words) - width + 1
    h = np.zeros(n, np.uint64)
    for j in range(width):  # order counts: each step mixes before it adds
        h = (h ^ (h >> np.uint64(29))) * np.uint64(_KEY) + one[j : j + n]
    h ^= h >> np.uint64(32)
    return np.unique(h * np.uint64(_KEY))


def _multipliers() -> np.ndarray:
    return np.random.default_rng(_SEED).integers(0, 1 << 31, BYTES, np.uint32) * np.uint32(2) + np.uint32(1)


def positional_bytes(hashes: np.ndarray, by: np.ndarray) -> bytes:
    """A byte of the least value of each of ``BYTES`` permutations of 32 bits over the set."""
    high = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(BYTES, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(high), _PART):
        part = high[None, at : at + _PART] * by[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    least ^= least >> np.uint32(16)
    return ((least * np.uint32(0x85EBCA6B)) >> np.uint32(24)).astype(np.uint8).tobytes()


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, node, bytes): digest of the set and positional bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = _multipliers()
        for b in batches:
            node, sketches = [], []
            for t in b.column(2):
                s = shingle_set(t.as_py())
                node.append(xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63))
                sketches.append(positional_bytes(s, by))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(node, pa.int64()), pa.array(sketches, pa.binary())], names=["doc_id", "text_hash", "node", "bytes"])

    return _texts(docs).mapInArrow(run, "doc_id long, text_hash long, node long, bytes binary")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")


def _sharing(pairs: DataFrame, least_shared: int) -> DataFrame:
    """Pairs (u, v, a, b) whose signatures a and b share that many positional bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, BYTES) for k in (2, 3))
            yield batch.select(["u", "v"]).filter(pa.array((a == b).sum(axis=1) >= least_shared))

    return pairs.select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def _sets(texts: DataFrame) -> DataFrame:
    """(node, hashes): each text's sorted shingle hashes, made once for all its pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingle_set(t.as_py()).tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary())], names=["node", "hashes"])

    return texts.select("node", "text").mapInArrow(run, "node long, hashes binary")


def _alike(pairs: DataFrame, threshold: float) -> DataFrame:
    """Pairs (u, v, a, b) whose sets a and b reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = ((np.frombuffer(x.as_py(), np.uint64) for x in batch.column(k)) for k in (2, 3))
            kept = [similarity(x, y) >= threshold for x, y in zip(*sets, strict=True)]
            yield batch.select(["u", "v"]).filter(pa.array(kept, pa.bool_()))

    return pairs.select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def _few(df: DataFrame) -> DataFrame:
    """Broadcast, if the (checkpointed) rows are few."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def verified(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs (u, v) of nodes (node, bytes) that pass the count filter and the threshold."""
    with_a = pairs.join(nodes.select(F.col("node").alias("u"), F.col("bytes").alias("a")), "u")
    with_b = with_a.join(nodes.select(F.col("node").alias("v"), F.col("bytes").alias("b")), "v")
    likely = checkpointed(_sharing(with_b, LEAST_SHARED))
    left = sets.select(F.col("node").alias("u"), F.col("hashes").alias("a"))
    right = sets.select(F.col("node").alias("v"), F.col("hashes").alias("b"))
    return checkpointed(_alike(likely.join(left, "u").join(right, "v"), threshold))


def _windows(sketch: Column, width: int, step: int) -> Column:
    """A posting key of each window of positional bytes."""
    return F.array(*[F.xxhash64(F.lit(at), F.substring(sketch, at + 1, width)) for at in range(0, BYTES - width + 1, step)])


def _lists(posts: DataFrame) -> DataFrame:
    """(key, node, least, n) of posts (key, node) in lists of two and more."""
    sizes = checkpointed(posts.groupBy("key").agg(F.min("node").alias("least"), F.count("*").alias("n")).filter("n > 1"))
    return checkpointed(posts.join(_few(sizes), "key").select("key", "node", "least", "n"))


def _in_parts(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, node, part, largest): the open lists' members with the component each is in."""
    named = lists.join(_few(roots.withColumnRenamed("node", "_node")), F.col("node") == F.col("_node"), "left").select("key", "node", F.coalesce("root", "node").alias("part"))
    sizes = named.groupBy("key", "part").agg(F.count("*").alias("m"))
    largest = sizes.groupBy("key").agg(F.max_by("part", F.struct("m", "part")).alias("largest"), F.count("*").alias("parts")).filter("parts > 1").drop("parts")
    return checkpointed(named.join(largest, "key"))


def _across_parts(members: DataFrame) -> DataFrame:
    """Distinct pairs (u, v) of a list's members in different components, once each."""
    a, b = members.filter("part <> largest").alias("a"), members.alias("b")
    unmet = (F.col("a.key") == F.col("b.key")) & (F.col("a.part") != F.col("b.part")) & ((F.col("b.part") == F.col("b.largest")) | (F.col("a.node") > F.col("b.node")))
    u, v = F.col("a.node"), F.col("b.node")
    return a.join(b, unmet).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct()


def shingle_links(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Links (u, v) of doc_ids that connect all documents that meet and reach the threshold."""
    signs = checkpointed(signatures(docs))
    # Equal sets are one node; the text of its least row stands for it.
    nodes = checkpointed(signs.groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("x"), F.first("bytes").alias("bytes")).select("node", "x.doc_id", "x.text_hash", "bytes"))
    lists = _lists(nodes.select("node", F.explode(_windows(F.col("bytes"), *LEVELS[0])).alias("key")))
    wanted = checkpointed(nodes.join(lists.select("node").distinct(), "node", "left_semi"))
    sets = checkpointed(_sets(_texts(docs).join(_few(wanted.drop("bytes")), ["doc_id", "text_hash"])).dropDuplicates(["node"]))
    stars, compared = lists, lists.filter(F.col("n") <= SHORT)
    for level, (width, step) in enumerate(LEVELS[1:], 2):
        again = checkpointed(wanted.select("node", "bytes").join(_few(checkpointed(lists.filter(F.col("n") > SHORT).select("node").distinct())), "node", "left_semi"))
        if again.isEmpty():
            break
        lists = _lists(again.select("node", F.explode(_windows(F.col("bytes"), width, step)).alias("key")))
        stars = stars.unionByName(lists)
        compared = compared.unionByName(lists if level == len(LEVELS) else lists.filter(F.col("n") <= SHORT))
    first = verified(stars.filter("node <> least").select(F.col("node").alias("u"), F.col("least").alias("v")).distinct(), wanted, sets, threshold)
    open_lists = _in_parts(compared.filter("n > 2"), star_components(first))
    links = first.unionByName(verified(_across_parts(open_lists), wanted, sets, threshold))
    ids = nodes.select("node", "doc_id")
    between = links.join(ids.select(F.col("node").alias("u"), F.col("doc_id").alias("du")), "u").join(ids.select(F.col("node").alias("v"), F.col("doc_id").alias("dv")), "v")
    copies = signs.select("node", F.col("doc_id").alias("du")).join(ids.select("node", F.col("doc_id").alias("dv")), "node")
    return between.select("du", "dv").unionByName(copies.select("du", "dv")).select(F.col("du").alias("u"), F.col("dv").alias("v")).filter("u <> v").distinct()
