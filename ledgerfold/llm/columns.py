"""Plain column names for the inside of an operator, whatever its caller's columns are called."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def plain_names(names: Sequence[str], keep: Sequence[str] = ("doc_id", "text", "source")) -> list[str]:
    """A plain name per column: its own for the columns in ``keep`` (by case first, the first of several), ``col_0``, ``col_1``, ... for others.

    Blanks, dots, colons and backticks, names that differ in case only, and names that helper columns have can then do no harm.
    """
    at = {}
    for wanted in keep:
        exact = [i for i, n in enumerate(names) if n == wanted]
        near = [i for i, n in enumerate(names) if n.lower() == wanted]
        if exact or near:
            at[(exact or near)[0]] = wanted
    return [at.get(i, f"col_{i}") for i in range(len(names))]


def plain(docs: DataFrame, keep: Sequence[str] = ("doc_id", "text", "source")) -> DataFrame:
    """``docs`` with plain names; ``toDF(*docs.columns)`` on its columns in order gives the caller's names back."""
    return docs.toDF(*plain_names(docs.columns, keep))
