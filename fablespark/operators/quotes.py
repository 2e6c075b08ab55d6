"""Where a quote stands in a corpus: exactly, after normalising, or nearly.

Nearly means an edit distance of at most ``max_share`` of the quote's normalised
length n, k say, to some stretch of the normalised text. Cut in k + s pieces, a quote
leaves s of them untouched at least, all on diagonals (place in the text less place
in the quote) that differ by k at most. So the first characters of each piece are
seeds: an inverted index of the texts under them gives postings (chunk, place), the join
with the quotes turns these into diagonals, and only where s different pieces lie in a
band of diagonals is the edit distance worked out, over that band. No pair of texts
is compared without that proof, and none that is near enough is lost.

A text holds all its places, so where the seeds are few (``NEAR_SEEDS``; their number goes by the quotes
alone) they are sent to the texts: bands are counted and quotes located where a text is read, once, and
nothing is shuffled. Beyond that, postings and quotes meet by a join, as follows.

Only places whose hash is in a bitmap of all seed hashes become postings. The bitmap is
built by an aggregate and has 2**27 bits at most (16 MB), however many quotes there are:
more seeds make it less selective, never wrong. Texts are then read twice, once for the
postings and once for the bands, and never copied a word or a place.

Normalised: lower case, runs of anything but letters and digits one space. Cases: a quote
or text without letters and digits is not found; null texts, quotes and ids neither;
repeated rows each come back; of several places the exact comes before the normalised,
this before the nearest; the least distance, then the first end, then the shortest wins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fablespark.operators.components import cut_lineage

MAX_SHARE = 0.1
#: Pieces are of six characters and more, where there is a choice, and at most three of them must be found.
PIECE, WANTED = 6, 3
#: Lengths of seeds: each piece takes the greatest that it holds.
SEED_SIZES = (12, 8, 6, 5, 4, 3, 2, 1)
MAX_BITS = 27
#: Characters of texts that a task works on at once (a single text may have more): what it holds doesn't go by the rows of a batch.
SLICE_CHARS = 500_000
#: Up to so many seeds and characters of quotes (some 20 MB in all), quotes are sent to the texts.
NEAR_SEEDS, NEAR_CHARS = 1 << 18, 1 << 24
#: Pairs of a place and a seed that a task holds at once (a single text may have more).
NEAR_HITS = 2_000_000
_BUCKET = 32768  # bits of one bitmap row of bitmap_construct_agg
_WORD = re.compile(r"[^\W_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def flat(text: str) -> str:
    return " ".join(w.lower() for w in _WORD.findall(text))


def allowed(size: int, max_share: float = MAX_SHARE) -> int:
    """Edits allowed to a quote of so many normalised characters."""
    return int(size * max_share + 1e-9)


def cut(quote: str, max_share: float = MAX_SHARE) -> tuple[list[tuple[int, str]], int]:
    """(offset, piece) of a normalised quote, and how many of the pieces an occurrence leaves untouched."""
    n = len(quote)
    k = allowed(n, max_share)
    wanted = max(1, min(WANTED, n // PIECE - k))
    ends = [n * i // (k + wanted) for i in range(k + wanted + 1)]
    return [(a, quote[a:b]) for a, b in zip(ends, ends[1:], strict=False)], wanted


def slices(batches: Iterator[pa.RecordBatch], *columns: int) -> Iterator[pa.RecordBatch]:
    """The rows of batches in slices of about ``SLICE_CHARS`` bytes of the given text columns; nothing is copied."""
    for b in batches:
        size = sum(pc.fill_null(pc.binary_length(b.column(c)), 0).to_numpy().astype(np.int64) for c in columns)
        ends = np.cumsum(size)
        at = 0
        while at < b.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + SLICE_CHARS, side="right")))
            yield b.slice(at, to - at)
            at = to


def gram_hashes(codes: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """For each size the hashes of so many code points at each place, 64 bits, mixed; one pass for all sizes."""
    h = np.zeros(len(codes), np.uint64)
    for j in range(max(sizes, default=0)):
        h = h[: max(0, len(codes) - j)] * _BASE + codes[j:]
        if j + 1 in sizes:
            x = h ^ (h >> np.uint64(29)) ^ np.uint64(j)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            yield j + 1, x ^ (x >> np.uint64(32))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def seeds(quotes: DataFrame, max_share: float = MAX_SHARE) -> DataFrame:
    """(hash, size, quote_id, piece, offset, n, wanted) of quotes (quote_id, quote)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            owner, rows = [], []
            for i, q in enumerate(b.column(1)):
                quote = flat(q.as_py())
                pieces, wanted = cut(quote, max_share) if quote else ([], 0)
                for no, (offset, piece) in enumerate(pieces):
                    size = next(s for s in SEED_SIZES if s <= len(piece))
                    owner.append(i)
                    rows.append((int(next(gram_hashes(_codes(piece[:size]), [size]))[1].astype(np.int64)[0]), size, no, offset, len(quote), wanted))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), b.column(0).take(pa.array(owner, pa.int32())), *[pa.array(c, pa.int32()) for c in cols[2:]]], names=["hash", "size", "quote_id", "piece", "offset", "n", "wanted"])

    kind = dict(quotes.dtypes)["quote_id"]
    return quotes.select("quote_id", "quote").mapInArrow(work, f"hash long, size int, quote_id {kind}, piece int, offset int, n int, wanted int")


def seed_bitmap(found: DataFrame) -> tuple[int, bytes]:
    """How many leading bits of a hash count, and the bitmap of those that occur; at most 2**MAX_BITS bits."""
    n = found.count()
    bits = max(15, min(MAX_BITS, (256 * max(1, n)).bit_length()))  # one place in 256 or more is there by chance
    place = F.shiftrightunsigned("hash", 64 - bits) + 1
    rows = found.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    out = bytearray((1 << bits) // 8)
    for r in rows:
        at = (r["bucket"] - 1) * _BUCKET // 8
        out[at : at + _BUCKET // 8] = r["bits"]
    return bits, bytes(out)


def postings(chunks: DataFrame, sizes: list[int], bits: int, bitmap: bytes) -> DataFrame:
    """(chunk_id, place, hash): the places of chunks (chunk_id, text) whose hash is in the bitmap."""
    shared = chunks.sparkSession.sparkContext.broadcast(bitmap)  # 16 MB at most

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(shared.value, np.uint8)
        for b in slices(batches, 1):
            texts = [flat(t.as_py()) for t in b.column(1)]
            ends = np.cumsum([len(t) + 1 for t in texts])
            codes = _codes("\n".join(texts))  # no normalised text holds a line end, so no seed runs over one
            for _, h in gram_hashes(codes, sizes):
                at = (h >> np.uint64(64 - bits)).astype(np.int64)
                hit = np.flatnonzero((known[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
                owner = np.searchsorted(ends, hit, side="right")
                place = hit - np.where(owner > 0, ends[owner - 1], 0)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(owner)), pa.array(place, pa.int32()), pa.array(h[hit].astype(np.int64))], names=["chunk_id", "place", "hash"])

    kind = dict(chunks.dtypes)["chunk_id"]
    return chunks.mapInArrow(work, f"chunk_id {kind}, place int, hash long")


def bands(hits: DataFrame, found: DataFrame, max_share: float = MAX_SHARE) -> DataFrame:
    """(chunk_id, quote_id, starts): where a quote may begin, of quotes enough of whose pieces lie near one diagonal."""
    k = F.floor(F.col("n") * F.lit(max_share) + F.lit(1e-9)).cast("int")
    width = k + 1  # diagonals of an occurrence differ by k at most: two neighbouring stretches of this width hold them
    diagonal = F.floor((F.col("place") - F.col("offset")) / width).cast("int")
    joined = hits.join(found, "hash").select("chunk_id", "quote_id", "piece", "wanted", width.alias("width"), F.explode(F.array(diagonal, diagonal - 1)).alias("band"))
    enough = joined.groupBy("chunk_id", "quote_id", "band", "wanted", "width").agg(F.size(F.collect_set("piece")).alias("pieces")).filter("pieces >= wanted")
    return enough.groupBy("chunk_id", "quote_id").agg(F.collect_set(F.col("band") * F.col("width")).alias("starts"))


def nearest(quote: str, text: str, from_start: bool = False) -> tuple[int, int]:
    """Least edit distance of ``quote`` to a stretch of ``text`` (or one from its start), and its first end.

    A column of the distance table is two bit vectors: where it steps down and where up.
    """
    m = len(quote)
    full, top = (1 << m) - 1, m - 1
    has: dict[str, int] = {}
    for i, c in enumerate(quote):
        has[c] = has.get(c, 0) | 1 << i
    down, up, score, best = full, 0, m, (m, 0)
    for j, c in enumerate(text, 1):
        x = has.get(c, 0) | up
        same = ((down + (x & down)) ^ down) | x
        left, right = down & same, up | (full & ~(down | same))
        score += (right >> top & 1) - (left >> top & 1)
        x = (right << 1 | from_start) & full
        up = x & same
        down = (left << 1 & full) | (full & ~(x | same))
        if score < best[0]:
            best = (score, j)
    return best


def near_span(quote: str, text: str, starts: list[int], max_share: float = MAX_SHARE) -> tuple[int, int, int] | None:
    """(distance, begin, end) of the nearest stretch of a normalised text, looked for behind the given starts."""
    n, k = len(quote), allowed(len(quote), max_share)
    spans: list[list[int]] = []
    for s in sorted(starts):
        a, b = max(0, s - k), min(len(text), s + 2 * (k + 1) + n + k)
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(b, spans[-1][1])
        else:
            spans.append([a, b])
    found = min(((d, a + end) for a, b in spans for d, end in [nearest(quote, text[a:b])] if d <= k), default=None)
    if found is None:
        return None
    distance, end = found
    # Read backwards from that end, the first stretch of the distance is the shortest.
    _, size = nearest(quote[::-1], text[max(0, end - n - k) : end][::-1], from_start=True)
    return distance, end - size, end


def original_span(text: str, begin: int, end: int) -> tuple[int, int]:
    """The characters of ``text`` that the normalised characters begin to end come from: first (from 1) and last."""
    at, first, last = 0, None, None
    for m in _WORD.finditer(text):
        size = len(m[0].lower())
        if first is None and begin < at + size:
            first = m.start() + min(max(0, begin - at), len(m[0]) - 1)
        if end <= at:
            break
        last = m.start() + min(end - at, len(m[0]))
        at += size + 1
    return first + 1, last


def locate(text: str, quote: str, starts: list[int] | None = None, max_share: float = MAX_SHARE, plain: str | None = None) -> tuple[str | None, int | None, int | None, int | None]:
    """(method, first, last, distance); without ``starts`` the pieces are looked for here. ``plain``: the text normalised, if that is known."""
    wanted = flat(quote)
    if not wanted:
        return None, None, None, None
    at = text.find(quote)
    if at >= 0:
        return "exact", at + 1, at + len(quote), 0
    plain = flat(text) if plain is None else plain
    at = plain.find(wanted)
    if at >= 0:
        return "normalised", *original_span(text, at, at + len(wanted)), 0
    if allowed(len(wanted), max_share) < 1:
        return None, None, None, None
    if starts is None:
        starts = []
        for offset, piece in cut(wanted, max_share)[0]:
            at = plain.find(piece)
            while at >= 0:
                starts.append(at - offset - allowed(len(wanted), max_share) - 1)
                at = plain.find(piece, at + 1)
    span = near_span(wanted, plain, starts, max_share)
    return ("fuzzy", *original_span(text, span[1], span[2]), span[0]) if span else (None, None, None, None)


_FOUND = "method string, first_char int, last_char int, distance int"


def _locating(batches: Iterator[pa.RecordBatch], max_share: float) -> Iterator[pa.RecordBatch]:
    """Batches whose last columns are text, quote and, perhaps null, starts."""
    for b in slices(batches, -3, -2):
        rows = [locate(t, q, s, max_share) if t is not None and q is not None else (None,) * 4 for t, q, s in zip(*[c.to_pylist() for c in b.columns[-3:]], strict=True)]
        cols = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([*b.columns[:-3], pa.array(cols[0], pa.string()), *[pa.array(c, pa.int32()) for c in cols[1:]]], names=[*b.schema.names[:-3], "method", "first_char", "last_char", "distance"])


def locate_pairs(pairs: DataFrame, keys: list[str], text: str = "text", quote: str = "quote", max_share: float = MAX_SHARE) -> DataFrame:
    """Quotes whose chunk is known, row by row: keys and method, first_char, last_char, distance; nulls where it isn't there."""
    kinds = dict(pairs.dtypes)
    rows = pairs.select(*keys, F.col(text).alias("text"), F.col(quote).alias("quote"), F.lit(None).cast("array<int>").alias("starts"))
    return rows.mapInArrow(partial(_locating, max_share=max_share), ", ".join([f"{c} {kinds[c]}" for c in keys] + [_FOUND]))


@dataclass
class SeedIndex:
    """Few quotes with all their seeds, sorted by hash: what a task needs to locate them."""

    ids: pa.Array  # of the quotes, each once
    quotes: list[list[str]]  # the quotes of each id
    sizes: list[int]
    bits: int
    bitmap: np.ndarray
    hashes: np.ndarray  # each once
    first: np.ndarray  # where the seeds of a hash begin
    owner: np.ndarray  # of each seed: its place in ids, piece and offset
    piece: np.ndarray
    offset: np.ndarray
    wanted: np.ndarray  # of each id
    width: np.ndarray


def seed_index(quotes: DataFrame, max_share: float = MAX_SHARE) -> SeedIndex | None:
    """The index of quotes (quote_id, quote), if there are few enough of them to send it around."""
    n, chars = quotes.agg(F.count("*"), F.coalesce(F.sum(F.length("quote")), F.lit(0))).first()
    if n * WANTED + chars * max(max_share, 0) > NEAR_SEEDS or chars > NEAR_CHARS:
        return None
    asked, found = quotes.select("quote_id", "quote").toArrow(), seeds(quotes, max_share).toArrow()
    ids = asked.column(0).combine_chunks().unique()
    place = {v: i for i, v in enumerate(ids.to_pylist())}
    texts: list[list[str]] = [[] for _ in place]
    for i, q in zip(asked.column(0).to_pylist(), asked.column(1).to_pylist(), strict=True):
        texts[place[i]].append(q)
    hashes = found.column("hash").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(hashes, kind="stable")
    each, first = np.unique(hashes[order], return_index=True)
    owner = np.array([place[v] for v in found.column("quote_id").to_pylist()], np.int64)[order]
    piece, offset, size, wanted = (found.column(c).to_numpy().astype(np.int64)[order] for c in ("piece", "offset", "n", "wanted"))
    # Quotes of one id: the least that one of them wants, the widest of their bands.
    least, width = np.full(len(place), WANTED, np.int64), np.ones(len(place), np.int64)
    np.minimum.at(least, owner, wanted)
    np.maximum.at(width, owner, np.floor(size * max_share + 1e-9).astype(np.int64) + 1)
    bits = max(15, min(MAX_BITS, (256 * max(1, len(each))).bit_length()))
    at = (each >> np.uint64(64 - bits)).astype(np.int64)
    bitmap = np.zeros((1 << bits) // 8, np.uint8)
    np.bitwise_or.at(bitmap, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return SeedIndex(ids, texts, sorted(set(found.column("size").to_pylist())), bits, bitmap, each, np.append(first, len(hashes)), owner, piece, offset, least, width)


def near_quotes(plain: list[str], index: SeedIndex) -> Iterator[tuple[int, int, list[int]]]:
    """(text, id, starts), by their places: what ``bands`` finds, in normalised texts at hand."""
    ends = np.cumsum([len(t) + 1 for t in plain])
    codes = _codes("\n".join(plain))  # no normalised text holds a line end, so no seed runs over one
    places, which = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for _, h in gram_hashes(codes, index.sizes):
        at = (h >> np.uint64(64 - index.bits)).astype(np.int64)
        hit = np.flatnonzero((index.bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
        seed = np.minimum(np.searchsorted(index.hashes, h[hit]), len(index.hashes) - 1)
        same = index.hashes[seed] == h[hit]
        places.append(hit[same])
        which.append(seed[same])
    at, seed = np.concatenate(places), np.concatenate(which)
    times = index.first[seed + 1] - index.first[seed]
    total = int(times.sum())
    if total > NEAR_HITS and len(plain) > 1:
        half = len(plain) // 2
        yield from near_quotes(plain[:half], index)
        for text, q, starts in near_quotes(plain[half:], index):
            yield half + text, q, starts
        return
    row = np.repeat(index.first[seed] - np.cumsum(times) + times, times) + np.arange(total)
    place = np.repeat(at, times)
    text, q = np.searchsorted(ends, place, side="right"), index.owner[row]
    pair, pairs, n = np.unique(text * len(index.ids) + q, return_inverse=True, return_counts=True)
    keep = np.flatnonzero(n[pairs] >= index.wanted[q])
    if not len(keep):
        return
    pairs, place, text, q, row = pairs[keep], place[keep], text[keep], q[keep], row[keep]
    band = (place - np.where(text > 0, ends[text - 1], 0) - index.offset[row]) // index.width[q]
    low = int(band.min()) - 1  # two neighbouring bands together hold an occurrence: each place counts in its own and the one before
    count, pieces = int(band.max()) - low + 1, int(index.piece.max()) + 1
    key = (pairs * count + band - low) * pieces + index.piece[row]
    found, n = np.unique(np.unique(np.concatenate([key, key - pieces])) // pieces, return_counts=True)
    owner = pair[found // count]
    text, q = owner // len(index.ids), owner % len(index.ids)
    keep = np.flatnonzero(n >= index.wanted[q])
    starts = (found[keep] % count + low) * index.width[q[keep]]
    cuts = [*np.flatnonzero(np.diff(owner[keep], prepend=-1)).tolist(), len(keep)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield int(text[keep[a]]), int(q[keep[a]]), starts[a:b].tolist()


def locate_near(chunks: DataFrame, index: SeedIndex, kind: str, max_share: float = MAX_SHARE) -> DataFrame:
    """``locate_quotes`` with few quotes (ids of type ``kind``): one pass over the texts."""
    shared = chunks.sparkSession.sparkContext.broadcast(vars(index))  # bounded, see NEAR_SEEDS; executors needn't have this module

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = SeedIndex(**shared.value)
        for b in slices(batches, 1):
            texts = b.column(1).to_pylist()
            plain = [flat(t) for t in texts]
            rows = [(i, q, *locate(texts[i], quote, starts, max_share, plain[i])) for i, q, starts in near_quotes(plain, index) for quote in index.quotes[q]]
            cols = list(zip(*(r for r in rows if r[2] is not None), strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(cols[0], pa.int32())), index.ids.take(pa.array(cols[1], pa.int32())), pa.array(cols[2], pa.string()), *[pa.array(c, pa.int32()) for c in cols[3:]]], names=["chunk_id", "quote_id", "method", "first_char", "last_char", "distance"])

    return chunks.mapInArrow(work, f"chunk_id {dict(chunks.dtypes)['chunk_id']}, quote_id {kind}, {_FOUND}")


def locate_quotes(chunks: DataFrame, quotes: DataFrame, max_share: float = MAX_SHARE) -> DataFrame:
    """(chunk_id, quote_id, method, first_char, last_char, distance) of all quotes (quote_id, quote) in all chunks (chunk_id, text)."""
    chunks = chunks.select("chunk_id", "text").filter("chunk_id is not null and text is not null")
    quotes = quotes.select("quote_id", "quote").filter("quote_id is not null and quote is not null")
    kinds = {c: dict(df.dtypes)[c] for c, df in (("chunk_id", chunks), ("quote_id", quotes))}
    index = seed_index(quotes, max_share)
    if index is not None:
        return locate_near(chunks, index, kinds["quote_id"], max_share)
    found = cut_lineage(seeds(quotes, max_share))
    sizes = [r["size"] for r in found.select("size").distinct().collect()]  # eight at most
    hits = postings(chunks, sizes, *seed_bitmap(found))
    near = bands(hits, found.drop("size"), max_share)
    rows = chunks.join(near, "chunk_id").join(quotes, "quote_id").select("chunk_id", "quote_id", "text", "quote", "starts")
    return rows.mapInArrow(partial(_locating, max_share=max_share), ", ".join([f"{c} {k}" for c, k in kinds.items()] + [_FOUND])).filter("method is not null")
