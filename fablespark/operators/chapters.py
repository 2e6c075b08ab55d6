"""Chunks, headings and chapters.

Orders are by explicit columns. Windows are partitioned by book, which bounds
a partition by one book's chunks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fablespark.functions.text import batch_sizes, batch_starts, bound, token_count
from fablespark.operators.components import written
from fablespark.operators.packing import pack


def chunk_documents(docs: DataFrame, doc: str = "doc_id", text: str = "text", max_tokens: int = 1024) -> DataFrame:
    """(doc, chunk_no, chunk_text, token_count): whole lines packed up to a token budget.

    A line over the budget is split by words first, so no chunk is over it.
    Each document is one row's work; nothing is shuffled.
    """
    words = F.filter(F.transform(F.split(text, "\n"), lambda x: F.array_remove(F.split(x, r"\s+"), "")), lambda w: F.size(w) > 0)
    pieces = F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 1, F.lit(0)), F.lit(max_tokens)), lambda i: F.slice(w, i + 1, F.lit(max_tokens)))))
    base = docs.select(F.col(doc), pieces.alias("pieces"))
    starts = batch_starts(F.transform("pieces", lambda p: F.size(p)), F.transform("pieces", lambda _: F.lit(max_tokens)))
    # Outer, as a filter for empty ones would be pushed down and cut each text once more.
    cut = base.withColumn("starts", starts).select(doc, "pieces", F.posexplode_outer(F.arrays_zip("starts", batch_sizes(F.col("starts"), F.size("pieces")).alias("size"))).alias("chunk_no", "z")).filter("chunk_no is not null")
    lines = F.slice("pieces", F.col("z")["starts"], F.col("z")["size"])
    out = cut.select(doc, "chunk_no", F.array_join(F.transform(lines, lambda x: F.array_join(x, " ")), "\n").alias("chunk_text"), F.aggregate(lines, F.lit(0), lambda n, x: n + F.size(x)).alias("token_count"))
    return out


def contextualised(headings: Column, text: Column) -> Column:
    """Headings before the text, for embedding only; the stored text stays clean."""
    return F.concat_ws("\n", headings, text)


def page_provenance(chunks: DataFrame, items: str = "item_pages") -> DataFrame:
    """Adds pages (sorted, repeats kept), page_start and page_end from nested item pages; empty ones go."""
    pages = F.array_sort(F.flatten(items))
    return chunks.withColumn("pages", pages).filter(F.size("pages") > 0).withColumns({"page_start": F.element_at("pages", 1), "page_end": F.element_at("pages", -1)})


def without_provenance(chunks: DataFrame, items: str = "item_pages") -> DataFrame:
    """The chunks that have no page: quarantined, never given page 0."""
    return chunks.filter(F.coalesce(F.size(F.flatten(items)), F.lit(0)) <= 0)


def first_headings(items: DataFrame, page: list[str], at: str, label: str = "label") -> DataFrame:
    """The first item of each page, if it is a heading."""
    w = Window.partitionBy(*page).orderBy(at)
    return items.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n").filter(F.col(label).isin("section_header", "title"))


def carry_forward(chunks: DataFrame, book: list[str], at: str, value: str, out: str) -> DataFrame:
    """The last value that isn't null, up to and with this row."""
    w = Window.partitionBy(*book).orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return chunks.withColumn(out, F.last(value, ignorenulls=True).over(w))


def auto_number(headings: DataFrame, book: list[str], at: str, number: str = "number", out: str = "auto_number", only: Column | None = None) -> DataFrame:
    """Numbers for headings without one: one more than the number before, from 1.

    ``only`` restricts counting to some rows (chapters), others get null; without
    it every heading takes a number.
    """
    rows = headings.withColumn("_ok", only if only is not None else F.lit(True))
    order = Window.partitionBy(*book).orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_island", F.count(F.when(F.col("_ok"), F.col(number))).over(order))
    rows = rows.withColumn("_base", F.coalesce(F.last(F.when(F.col("_ok"), F.col(number)), ignorenulls=True).over(order), F.lit(0)))
    inside = Window.partitionBy(*book, "_island").orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    step = F.sum(F.when(F.col("_ok") & F.col(number).isNull(), 1).otherwise(0)).over(inside)
    return rows.withColumn(out, F.when(F.col("_ok"), (F.col("_base") + step).cast("int"))).drop("_ok", "_island", "_base")


def chapter_ranges(chapters: DataFrame, book: list[str], page: str = "page_start", page_count: str = "page_count") -> DataFrame:
    """page_end: the page before the next chapter; the last one ends with the book."""
    w = Window.partitionBy(*book).orderBy(page)
    return chapters.withColumn("page_end", F.coalesce(F.lead(page).over(w) - 1, F.col(page_count)).cast("int"))


def backfill_chapters(chunks: DataFrame, chapters: DataFrame, book: str, page: str = "page_start") -> DataFrame:
    """Chunks with the number of the chapter whose page range they start in.

    Ranges of a book don't overlap, so a union sorted by page and one window
    do what a range join would, in one shuffle.
    """
    marks = chapters.select(book, F.col("page_start").alias("_page"), F.lit(0).alias("_kind"), F.struct("number", "page_end").alias("_chapter"))
    rows = chunks.select(F.col(book), F.col(page).alias("_page"), F.lit(1).alias("_kind"), F.struct(*[F.col(c) for c in chunks.columns]).alias("_row"))
    w = Window.partitionBy(book).orderBy("_page", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = marks.unionByName(rows, allowMissingColumns=True).withColumn("_active", F.last("_chapter", ignorenulls=True).over(w)).filter("_kind = 1")
    return swept.select("_row.*", F.when(F.col("_page") <= F.col("_active.page_end"), F.col("_active.number")).alias("chapter_number"))


def token_batches(chunks: DataFrame, book: list[str], at: str, tokens: str = "token_count", max_context: int = 16384, reserve: int = 2048, shell_tokens: int = 200, lookback: int = 5, beside: tuple[str, ...] = ()) -> DataFrame:
    """Chunks with batch_no: packed greedily in order, never split.

    A batch's budget is what the context leaves after the prompt's shell, the
    ``lookback`` chunks before the batch and the reserve. A chunk over it stands
    alone. Books of any length are packed, see ``packing``. Columns ``beside`` go along.
    """
    return pack(chunks, book, [at], tokens, max_context - reserve - shell_tokens, lookback, beside)


def split_oversized(items: DataFrame, text: str, budget: int) -> DataFrame:
    """Items with part_no and was_split: those over the budget cut into parts of at most ``budget`` words; a null text is one null part."""
    words = F.coalesce(F.array_remove(F.split(text, r"\s+"), ""), F.array().cast("array<string>"))
    # Bound, as a text would be split anew for each of its parts.
    parts = bound(words, lambda w: F.when(F.size(w) > budget, F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 1, F.lit(0)), F.lit(budget)), lambda i: F.array_join(F.slice(w, i + 1, F.lit(budget)), " "))).otherwise(F.array(F.col(text))))
    return items.withColumn("was_split", F.size(words) > budget).select("*", F.posexplode(parts).alias("part_no", "part_text"))


def plan_batches(items: DataFrame, group: list[str], at: str, text: str, budget: int, texts: bool = True) -> DataFrame:
    """(group, at, part_no, part_text, tokens, was_split, batch_no): items over the budget split, then all packed in order.

    No batch holds more than ``budget`` tokens (white-space words). A null text is one part of none. Only the
    sizes are packed; their numbers come back to the texts by (group, at, part_no), which tell parts apart.
    Without ``texts`` there is no part_text, and each text is read once, to count its words.
    """
    sized = items.select(*group, at, token_count(F.col(text)).alias("_words"))
    sizes = F.transform(F.sequence(F.lit(0), F.greatest(F.col("_words") - 1, F.lit(0)), F.lit(budget)), lambda i: F.least(F.col("_words") - i, F.lit(budget)))
    sized = written(sized.select(*group, at, (F.col("_words") > budget).alias("was_split"), F.posexplode(sizes).alias("part_no", "tokens")))
    keys = [*group, at, "part_no"]
    packed = pack(sized, group, [at, "part_no"], "tokens", budget, beside=("tokens", "was_split"))
    if not texts:
        return packed.select(*keys, "tokens", "was_split", "batch_no")
    parts = split_oversized(items.select(*group, at, text), text, budget).drop(text, "was_split")
    numbers = packed.select(*[F.col(c).alias(f"_{c}") for c in keys], "tokens", "was_split", "batch_no")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys])
    return parts.join(numbers, same).select(*group, at, "part_no", "part_text", "tokens", "was_split", "batch_no")


def batch_stats(batches: DataFrame, by: list[str], tokens: str | None = None) -> DataFrame:
    """Least, mean (rounded down) and greatest number of chunks a batch; of tokens too, if a column holds them."""
    each = [F.count("*").alias("size")] + ([F.sum(tokens).alias("held")] if tokens else [])
    sizes = batches.groupBy(*by, "batch_no").agg(*each)
    stats = [F.count("*").alias("n_batches"), F.min("size").alias("min_size"), F.floor(F.sum("size") / F.count("*")).alias("mean_size"), F.max("size").alias("max_size")]
    if tokens:
        stats += [F.min("held").alias("min_tokens"), F.floor(F.sum("held") / F.count("*")).alias("mean_tokens"), F.max("held").alias("max_tokens")]
    return sizes.groupBy(*by).agg(*stats)


def chapter_preview(chunks: DataFrame, text: str = "text") -> DataFrame:
    """Chunks of chapters as a 20-character preview and "number title"."""
    return chunks.filter("is_chapter").withColumns({"preview": F.substring(text, 1, 20), "chapter": F.concat_ws(" ", F.col("number").cast("string"), "title")})


def with_context(rows: DataFrame, book: list[str], at: str, text: str, before: int = 1, after: int = 1, out: str = "context") -> DataFrame:
    """A row's text with its neighbours', in order (sentence or chunk context)."""
    w = Window.partitionBy(*book).orderBy(at).rowsBetween(-before, after)
    return rows.withColumn(out, F.array_join(F.collect_list(text).over(w), " "))


def page_spans(items: DataFrame, page: int | None = None) -> DataFrame:
    """(book_id, page, chunk_id, x0, y0, x1, y1): the box that a chunk's items take on each page."""
    rows = items if page is None else items.filter(F.col("page") == page)
    return rows.groupBy("book_id", "page", "chunk_id").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
