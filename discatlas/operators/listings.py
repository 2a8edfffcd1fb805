"""Listings: letter index, paging, filters, facets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE_SIZES = (25, 50, 100, 250)


def letter_pages(rows: DataFrame, column: str, size: int) -> DataFrame:
    """Page on which each first letter begins: letter, n, page. Blank names are left out.

    Only the counts per letter are ordered, not the rows.
    """
    letters = rows.where(F.trim(column) != "").groupBy(F.upper(F.substring(F.trim(column), 1, 1)).alias("letter")).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("letter").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return letters.select("letter", "n", (F.floor(before / size) + 1).cast("long").alias("page"))


def distinct_totals(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """One row: n_rows and the distinct non-null values of columns."""
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), *(F.count_distinct(c).alias(n) for n, c in columns.items()))


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> tuple[DataFrame, bool]:
    """(rows of a page from 1, whether more follow): one row more than the page is asked for, and kept, so the plan runs once."""
    number, size = max(1, number), size if size in PAGE_SIZES else PAGE_SIZES[0]
    asked = rows.orderBy(*order).offset((number - 1) * size).limit(size + 1).collect()
    return rows.sparkSession.createDataFrame(asked[:size], rows.schema), len(asked) > size


def capped_trees(rows: DataFrame, tree: str, kind: str, order: list[Column], most: int = 200_000) -> DataFrame:
    """The first `most` rows of each kind in every tree, and in is_truncated whether the tree had more of any kind.

    One row more than the cap is kept to tell, so no task holds more of a tree
    than that after its part of the rows is cut.
    """
    nth = F.row_number().over(Window.partitionBy(tree, kind).orderBy(*order))
    kept = rows.withColumn("__nth", nth).where(F.col("__nth") <= most + 1)
    whole = kept.withColumn("is_truncated", F.max("__nth").over(Window.partitionBy(tree)) > most)
    return whole.where(F.col("__nth") <= most).drop("__nth")


def clamp_page(number: int, total: int, size: int) -> int:
    """The page number that exists: between 1 and the last."""
    return max(1, min(number, -(-total // size) if size > 0 else 1))


def sort_columns(column: str | None, descending: bool, allowed: dict[str, str], default: str, tie: str = "id") -> list[Column]:
    """Order by one of the allowed columns, nulls last, with the id as last key."""
    chosen = F.col(allowed.get(column or "", allowed[default]))
    return [chosen.desc_nulls_last() if descending else chosen.asc_nulls_last(), F.col(tie).asc()]


def ranked(column: Column | str, ranks: list[str]) -> Column:
    """Position of a value in a fixed list; values that are not in it come last."""
    c = F.col(column) if isinstance(column, str) else column
    out = F.lit(len(ranks))
    for i, value in reversed(list(enumerate(ranks))):
        out = F.when(c == value, i).otherwise(out)
    return out
