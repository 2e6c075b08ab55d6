"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Fingerprints of 64 bits are eight positional bytes. Two that differ in at most
``max_bits`` = 2 bits share at least six of the eight, the guaranteed minimum. The
index posts each distinct fingerprint under every choice of six positions and the
bytes there, so a posting list holds those that share these six. The meetings of a pair
are tallied: two that share s bytes meet in as many lists as there are choices of six
out of s (1, 7 or 28), so the count of lists tells the count of shared bytes. Pairs that
reach the minimum are retained and verified by their differing
bits. Members of a list differ in two bytes only, so it has 65,536 at most, however
many documents there are; on the check tables with a group of thousands of near
copies the longest list had 16.

Copies with one fingerprint are one node of the graph (its least doc_id) and
are never expanded into pairs.

Cases: a null text counts as an empty one; texts without words have the
fingerprint zero, linked like any other; repeated rows each come back, with the
same values; a row with a null doc_id keeps its fingerprint, links nothing and
has a null component; an empty table gives an empty result; other columns of
the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fablespark.llm.common import checkpointed, free_prefix, quoted
from fablespark.llm.components import star_components
from fablespark.llm.shingle_links import shingle_links

SHINGLE_WORDS = 3
MAX_BITS = 2
_SEED = 42


def fingerprint_of(text: str | None, width: int = SHINGLE_WORDS) -> int:
    """The 64-bit fingerprint of one text, as a signed number.

    bytes.lower() and bytes.split() touch just A-Z and the ASCII white space
    x20, x09 to x0D, which is the word rule.
    """
    words = text.encode("utf-8", "replace").lower().split() if isinstance(text, str) else []
    if not words:
        return 0
    if len(words) <= width:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), _SEED)]
    else:
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate([[0], ends[:-1]])
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a:b], _SEED) for a, b in zip(starts[: len(words) - width + 1].tolist(), (ends[width - 1 :] - 1).tolist(), strict=True)]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = np.array(hashes[at : at + 65536], dtype="<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp long) of every row, in one pass over whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [fingerprint_of(t.as_py(), width) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def _postings(nodes: DataFrame, least_shared: int) -> DataFrame:
    """(positions, bytes, rep, fp): a posting for each choice of ``least_shared`` positions."""
    keys = []
    for chosen in combinations(range(8), least_shared):
        positions = sum(1 << p for p in chosen)
        mask = sum(0xFF << (8 * p) for p in chosen)
        mask = mask - (1 << 64) if mask >= 1 << 63 else mask
        keys.append(F.struct(F.lit(positions).alias("positions"), F.col("fp").bitwiseAND(F.lit(mask)).alias("bytes")))
    return nodes.select("rep", "fp", F.explode(F.array(*keys)).alias("k")).select("k.positions", "k.bytes", "rep", "fp")


def shared_bytes(nodes: DataFrame, least_shared: int) -> DataFrame:
    """(u, v, left, right, shared): the pairs of nodes (rep, fp) that meet in the index, and how many positional bytes they share."""
    posts = _postings(nodes, least_shared)
    a, b = posts.alias("a"), posts.alias("b")
    same = (F.col("a.positions") == F.col("b.positions")) & (F.col("a.bytes") == F.col("b.bytes")) & (F.col("a.fp") < F.col("b.fp"))
    met = a.join(b, same).groupBy(F.col("a.rep").alias("u"), F.col("b.rep").alias("v"), F.col("a.fp").alias("left"), F.col("b.fp").alias("right")).agg(F.count("*").alias("lists"))
    of_lists = F.create_map(*[F.lit(x).cast("long") for s in range(least_shared, 9) for x in (comb(s, least_shared), s)])
    return met.select("u", "v", "left", "right", F.element_at(of_lists, F.col("lists")).alias("shared"))


def near_links(nodes: DataFrame, max_bits: int = MAX_BITS, least_shared: int | None = None) -> DataFrame:
    """Links (u, v) between nodes (rep, fp) within ``max_bits`` of each other.

    Such a pair differs in ``max_bits`` bytes at most; ``least_shared`` may name a smaller
    number of bytes for the index, the minimum for a pair stays.
    """
    minimum = 8 - max_bits
    retained = shared_bytes(nodes, least_shared or minimum).filter(F.col("shared") >= minimum)
    return retained.filter(F.bit_count(F.col("left").bitwiseXOR(F.col("right"))) <= max_bits).select("u", "v")


def _nodes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) of every row, and (fp, rep): each fingerprint with its least doc_id."""
    fps = checkpointed(fingerprints(docs))
    return fps, checkpointed(fps.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")))


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs`` (doc_id, text)."""
    fps, nodes = _nodes(docs)
    roots = star_components(near_links(nodes, max_bits))
    named = nodes.join(roots, nodes["rep"] == roots["node"], "left").select(F.col("fp").alias("_fp"), F.coalesce("root", "rep").alias("_component"))
    return fps.join(named, fps["fp"] == named["_fp"], "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("_component")).alias("component_id"))


def hex_digits(fp: Column) -> Column:
    """16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the least of its group, each doc_id once.

    A group is connected by fingerprints within ``MAX_BITS`` and by five-word
    shingle similarity of 0.8 or more (``shingle_links``). Of rows that repeat a
    kept doc_id, that with the least hash stays. Rows with a null doc_id all stay.
    """
    kept_id, times = (free_prefix(docs) + c for c in ("kept", "times"))
    fps, nodes = _nodes(docs.select("doc_id", "text"))
    copies = fps.filter("doc_id is not null").join(nodes, "fp").filter("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    gone = star_components(copies.unionByName(near_links(nodes)).unionByName(shingle_links(docs.select("doc_id", "text")))).select(F.col("node").alias("gone"))
    ids = fps.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias(times))
    kept = ids.join(gone, F.col("doc_id") == F.col("gone"), "left_anti").withColumnRenamed("doc_id", kept_id)
    joined = docs.join(kept, docs["doc_id"].cast("long") == kept[kept_id])
    single = joined.filter(F.col(times) == 1).select(*quoted(docs.columns))
    rows = joined.filter(F.col(times) > 1)
    rule = F.struct(F.sha2(F.col("text").cast("binary"), 256), F.xxhash64(*quoted(docs.columns)))
    repeated = rows.groupBy(kept_id).agg(F.min_by(F.struct(*quoted(docs.columns)), rule).alias(times)).select(*[F.col(times).getField(c).alias(c) for c in docs.columns])
    return single.unionByName(repeated).unionByName(docs.filter("doc_id is null"))
