"""Errors of syntax as a column, and the gate that compares them."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grammar import count_errors
from ..functions.scanner import Unreadable
from ..plans.fold import FOLDED, MARKUP


def _count(source: str | None, language: str | None) -> int | None:
    if source is None or language not in (*FOLDED, "python"):
        return None
    try:
        if language == "python":
            ast.parse(source)
            return 0
        return count_errors(source, language, language in MARKUP)
    except (Unreadable, SyntaxError, RecursionError, ValueError):
        return -1


def error_count(content: str | Column, language: str | Column) -> Column:
    """The number of syntax errors of a source: -1 for one that doesn't scan (Python: parse), null for other languages and null texts."""

    @F.pandas_udf("int")
    def counted(contents, languages):
        return pd.Series([_count(c if isinstance(c, str) else None, x) for c, x in zip(contents, languages, strict=True)], dtype="Int32")

    return counted(content, language)


def unreadable_sources(files: DataFrame) -> DataFrame:
    """Files (path, language, content) that don't scan."""
    return files.where(error_count("content", "language") == -1).select("path")


def broken(rewrites: DataFrame) -> DataFrame:
    """Rewrites (path, language, before, after) with more errors than their source, or that don't scan though it did: path, errors before and after."""
    counted = rewrites.select("path", error_count("before", "language").alias("errors_before"), error_count("after", "language").alias("errors_after"))
    worse = (F.col("errors_after") > F.col("errors_before")) & (F.col("errors_before") >= 0) | (F.col("errors_after") == -1) & (F.col("errors_before") >= 0)
    return counted.where(worse)
