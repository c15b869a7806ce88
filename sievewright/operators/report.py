"""Reports of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import diff
from .relational import tally


def summary(results: DataFrame, staleness: str) -> str:
    """The closing line of a run: outcomes, most first, then by name. Only the counts of outcomes come to the driver."""
    counts = [(r.action, r.n) for r in tally(results, "action").collect()]
    total = sum(n for _, n in counts)
    if not total:
        return f"0 removal candidates (staleness={staleness}), nothing to do"
    return f"{total} {'candidate' if total == 1 else 'candidates'}: {', '.join(f'{n} {a}' for a, n in counts)}"


def line(key: Column, action: Column, status: Column, treatment: Column, url: Column) -> Column:
    """A result's first line."""
    return F.concat(F.lit("["), action, F.lit("] "), key, F.lit(" (status="), status, F.lit(", treatment="), F.initcap(treatment.cast("string")), F.lit(")"), F.when(F.coalesce(url, F.lit("")) != "", F.concat(F.lit(" "), url)).otherwise(""))


def lines(results: DataFrame) -> DataFrame:
    """seq and text of each result, in order, warnings below."""
    text = line(F.col("key"), F.col("action"), F.col("status"), F.col("treatment"), F.col("pr_url"))
    left = F.when(F.size("unprocessed_files") > 0, F.concat(F.lit("\n    warning: "), F.size("unprocessed_files").cast("string"), F.lit(" file(s) still mention this flag: "), F.array_join("unprocessed_files", ", "))).otherwise("")
    refused = F.when(F.size("refusal_reasons") > 0, F.concat(F.lit("\n    refused: "), F.array_join(F.transform("refusal_reasons", lambda r: F.concat(r["file"], F.lit(" ("), r["reason"], F.lit(")"))), ", "))).otherwise("")
    waits = F.when(F.size("blocked_by") > 0, F.concat(F.lit("\n    waiting on: "), F.array_join("blocked_by", ", "))).otherwise("")
    return results.select("seq", F.concat(text, left, refused, waits).alias("text")).orderBy("seq")


def flag_diffs(rewrites: DataFrame) -> DataFrame:
    """flag and the unified diff of its files, by path."""
    one = rewrites.select("flag", "path", diff("path", "before", "after").alias("diff")).where("diff != ''")
    return one.groupBy("flag").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "diff"))), lambda x: x["diff"]), "").alias("diff"))


def bodies(results: DataFrame, findings: DataFrame) -> DataFrame:
    """key and the body of its request: what it does, then each kind of finding as a list."""
    one = findings.select("flag", "kind", F.concat(F.lit("- `"), "path", F.when(F.col("line").isNotNull(), F.concat(F.lit(":"), F.col("line").cast("string"))).otherwise(""), F.lit("` "), F.coalesce("reason", "text", F.lit(""))).alias("item"))
    kinds = one.groupBy("flag", "kind").agg(F.array_join(F.array_sort(F.collect_set("item")), "\n").alias("items"))
    parts = kinds.groupBy(F.col("flag").alias("key")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kind", "items"))), lambda k: F.concat(F.lit("### "), k["kind"], F.lit("\n\n"), k["items"])), "\n\n").alias("parts"))
    head = F.format_string("Removes `%s`, which always served **%s**.", F.col("key"), F.col("treatment").cast("string"))
    return results.join(parts, "key", "left").select("key", F.concat_ws("\n\n", head, F.col("parts")).alias("body"))
