"""The catalogue as DataFrames: valid deliveries only, and the same views as SQL for the oracle."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from discatlas.tables import first_delivery, load


class Catalogue:
    """Tables of a data folder with one row per id. Columns are pruned by whoever reads them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return load(self.spark, self.folder, name)

    def _first(self, name: str, key: str = "id") -> DataFrame:
        return first_delivery(self.raw(name), key)

    def files_of(self, *columns: str) -> DataFrame:
        """Extracted files with the id and these columns, none of them loaded_at.

        Deliveries of a row hold the same content, so the distinct rows of these
        columns are one per id; unlike a choice by arrival, that lets filters
        through to the scan and is combined before the shuffle.
        """
        return self.raw("extracted_files").select(*dict.fromkeys(("id", *columns))).distinct()

    @cached_property
    def files(self) -> DataFrame:
        return self._first("extracted_files")

    @cached_property
    def items(self) -> DataFrame:
        return self._first("catalogue_items")

    @cached_property
    def artefacts(self) -> DataFrame:
        return self._first("artefacts")

    @cached_property
    def partitions(self) -> DataFrame:
        return self._first("disc_partitions")

    @cached_property
    def blobs(self) -> DataFrame:
        return self._first("upload_blobs")

    @cached_property
    def stored(self) -> DataFrame:
        return self._first("stored_objects", "object_id")

    @cached_property
    def analyses(self) -> DataFrame:
        return self._first("analyses")

    @cached_property
    def users(self) -> DataFrame:
        return self._first("users")

    @cached_property
    def keys(self) -> DataFrame:
        return self._first("api_keys")

    @cached_property
    def documents(self) -> DataFrame:
        return self.raw("documents")


def _view(name: str, table: str, key: str = "id") -> str:
    return f"{name} AS (SELECT * FROM {table} QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY loaded_at) = 1)"


#: Views of the oracle: i items, a artefacts, p partitions, f files, b blobs, so stored objects, an analyses, u users, k keys.
PRELUDE = "WITH RECURSIVE " + ", ".join(
    _view(*v)
    for v in (
        ("i", "catalogue_items"), ("a", "artefacts"), ("p", "disc_partitions"), ("f", "extracted_files"), ("b", "upload_blobs"),
        ("so", "stored_objects", "object_id"), ("an", "analyses"), ("u", "users"), ("k", "api_keys"),
    )
)


class Registry:
    """Named queries of one module and their SQL."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracle: dict[str, str] = {}

    def query(self, sql: str | None = None, name: str | None = None):
        """Register a function of a Catalogue under its own name; sql continues the prelude's WITH list after a comma or selects."""

        def register(build: Callable[[Catalogue], DataFrame]) -> Callable[[Catalogue], DataFrame]:
            def run(spark: SparkSession, folder: str) -> DataFrame:
                return build(Catalogue(spark, folder))

            run.__doc__ = build.__doc__
            self.queries[name or build.__name__] = run
            if sql is not None:
                self.oracle[name or build.__name__] = PRELUDE + (sql if sql.lstrip().startswith(",") else " " + sql)
            return build

        return register


def count(condition: Column) -> Column:
    """How many rows meet a condition; null counts as not met."""
    return F.count_if(F.coalesce(condition, F.lit(False)))
