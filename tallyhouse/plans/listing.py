"""Lists of records: search, pages, distinct values, and records that a list names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def searched(rows: DataFrame, **texts: str) -> DataFrame:
    """Rows of which one of the columns holds its text, in any case; % and _ stand for any characters and any one."""
    found = F.lit(False)
    for column, text in texts.items():
        found = found | F.col(column).ilike(f"%{text}%")
    return rows.where(found)


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """A page by its number, from 1. Each task keeps the rows up to the page's end, so that far pages cost more: see after()."""
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def after(rows: DataFrame, order: list[tuple[str, bool]], last: tuple | None, size: int) -> DataFrame:
    """The ``size`` rows that follow a row whose order columns are ``last``; the first ones without it.

    order: columns, with whether they descend; NULLs come last, and together the columns tell rows apart. The condition
    reaches the scan, and each task keeps ``size`` rows: a far page costs what the first does, and no row is skipped or
    shown twice when others are added or go.
    """
    if last is not None:
        follows = F.lit(False)
        for (column, falls), value in reversed(list(zip(order, last))):
            c, same = F.col(column), F.col(column).eqNullSafe(F.lit(value)) & follows
            follows = same if value is None else (c < F.lit(value) if falls else c > F.lit(value)) | c.isNull() | same
        rows = rows.where(follows)
    return rows.orderBy(*[F.desc_nulls_last(c) if falls else F.asc_nulls_last(c) for c, falls in order]).limit(size)


def values(rows: DataFrame, column: str, *more: str) -> DataFrame:
    """The distinct values of a column, with those of others beside it; rows where it is NULL are left out."""
    return rows.where(F.col(column).isNotNull()).select(column, *more).distinct()


def with_skus(mappings: DataFrame, skus: DataFrame) -> DataFrame:
    """Mappings with sku_code and sku_name of their SKU, if it has a record."""
    names = skus.select(F.col("id").alias("sku_id"), "sku_code", F.col("name").alias("sku_name"))
    return mappings.join(names, "sku_id", "left")


def missing(asked: DataFrame, records: DataFrame) -> DataFrame:
    """Rows of asked whose id no record has."""
    return asked.join(records.select("id"), "id", "left_anti")
