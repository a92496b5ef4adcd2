"""Evaluating a computed value once."""

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, however often it is used."""
    return F.get(F.transform(F.array(value), body), 0)


def rows_of(df: DataFrame, keep: list[str], items: Column, name: str) -> DataFrame:
    """One row per array element.

    The outer form with a filter behind it: for a plain ``explode`` the optimizer
    adds a "not empty" filter below it and so evaluates a computed array twice.
    """
    return df.select(*keep, F.explode_outer(items).alias(name)).where(F.col(name).isNotNull())


def literal_table(value: object, ddl: str) -> Column:
    """A nested constant; the optimizer folds the parse into a literal."""
    return F.from_json(F.lit(json.dumps(value, ensure_ascii=False)), ddl)
