"""Candidates: which are taken up, and what becomes of the others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys
from .relational import first_by, limited


def _listed(key: Column, names: list[str]) -> Column:
    """Whether a list has the key, itself or by a beginning."""
    found = key.isin(*(n for n in names if not n.endswith("*"))) if any(not n.endswith("*") for n in names) else F.lit(False)
    for n in names:
        if n.endswith("*"):
            found = found | key.startswith(n[:-1])
    return found


def decide(candidates: DataFrame, ignore: list[str] = (), allow: list[str] = (), aliases: dict[str, str] | None = None, known: DataFrame | None = None, handled: DataFrame | None = None) -> DataFrame:
    """candidates with branch, code_key and action: the first of ignored (deny wins over allow), not-selected, unsafe-key, duplicate, blocked, already-handled that holds, else null.

    A key is unsafe if it has no branch, if its code spelling can't be searched for, or if that is another flag's key
    (known: a table of key). Of rows with one branch, the one of least seq that got so far claims it.
    handled: a table of branches that had a removal. ignore and allow: keys, or beginnings of keys before a `*`.
    """
    key = F.col("key")
    spelled = F.lit(None).cast("string")
    for flag, code in (aliases or {}).items():
        spelled = F.coalesce(spelled, F.when(key == flag, F.lit(code)))
    rows = candidates.withColumn("branch", keys.removal_branch(key)).withColumn("code_key", F.coalesce(spelled, key))
    if known is not None:
        taken = known.select(F.col("key").alias("code_key")).distinct().withColumn("_taken", F.lit(True))
        rows = rows.join(taken, "code_key", "left").withColumn("_taken", F.col("_taken") & (F.col("code_key") != key))
    else:
        rows = rows.withColumn("_taken", F.lit(False))
    first = F.when(_listed(key, ignore), "ignored")
    if allow:
        first = first.when(~_listed(key, allow), "not-selected")
    first = first.when(F.col("branch").isNull() | ~keys.is_code_key(F.col("code_key")) | F.coalesce("_taken", F.lit(False)), "unsafe-key")
    rows = rows.withColumn("_first", first)
    claims = first_by(rows.where("_first is null").select("branch", "seq"), ["branch"], ["seq"]).withColumnRenamed("seq", "_claim")
    rows = rows.join(claims, "branch", "left")
    if handled is not None:
        rows = rows.join(handled.select("branch").distinct().withColumn("_handled", F.lit(True)), "branch", "left")
    else:
        rows = rows.withColumn("_handled", F.lit(False))
    action = F.when(F.col("_first").isNotNull(), F.col("_first")).when(F.col("seq") != F.col("_claim"), "duplicate").when(F.size("blocked_by") > 0, "blocked").when(F.col("_handled"), "already-handled")
    return rows.withColumn("action", action).select(*candidates.columns, "branch", "code_key", "action")


def is_proposal() -> Column:
    """Whether a result used up one of a run's proposals: an opened request, or the diff of a dry run."""
    return (F.col("action") == "pr-opened") | ((F.col("action") == "dry-run") & (F.coalesce(F.col("diff"), F.lit("")) != ""))


def up_to(results: DataFrame, most: int) -> DataFrame:
    """Results of a run that stops after `most` proposals; 0: no limit."""
    return limited(results, F.col("seq"), is_proposal(), most, ["key"])


def alias_conflicts(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """Candidates whose code spelling is the key of another flag."""
    other = known.select(F.col("key").alias("code_key")).distinct()
    return candidates.where("code_key != key").join(other, "code_key", "left_semi")
