"""Reading positions (book_order, chapter): a null chapter counts as 0 on both sides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def at_or_before(book_order: Column, chapter: Column, limit_book: int, limit_chapter: int | None) -> Column:
    """True up to the reading position. Written so that the first conjunct reaches the scan."""
    limit = limit_chapter if limit_chapter is not None else 0
    return (book_order <= limit_book) & ((book_order < limit_book) | (F.coalesce(chapter, F.lit(0)) <= limit))


def position(book_order: Column, chapter: Column) -> Column:
    """A struct that sorts in reading order."""
    return F.struct(book_order.alias("book_order"), F.coalesce(chapter, F.lit(0)).alias("chapter"))


def at_or_before_sql(book: str, chapter: str, limit_book: int, limit_chapter: int) -> str:
    return f"({book} <= {limit_book} AND ({book} < {limit_book} OR coalesce({chapter}, 0) <= {limit_chapter}))"
