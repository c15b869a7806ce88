"""Values that every site agrees on, and gates on the tables before and after a rewrite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tokens
from .relational import agreed, first_by


def registry_default(entries: DataFrame) -> DataFrame:
    """The one default of each flag (flag, value), null where declarations disagree."""
    return agreed(entries, ["flag"], "value")


def first_owner(captures: DataFrame) -> DataFrame:
    """The first owner recorded for each path (path, owner, seq)."""
    return first_by(captures, ["path"], ["seq"])


def removable_parameters(sites: DataFrame) -> DataFrame:
    """Constructor parameters (constructor, parameter) that all sites agree to lose (ok)."""
    return sites.groupBy("constructor", "parameter").agg(F.bool_and(F.coalesce("ok", F.lit(False))).alias("ok")).where("ok").drop("ok")


def constant_arguments(calls: DataFrame, keys: list[str]) -> DataFrame:
    """Parameters that get one literal at every call (value, literal), with it: function parameters, positional arguments and component properties alike."""
    same = (F.min("value") == F.max("value")) & F.bool_and(F.coalesce("literal", F.lit(False))) & (F.count("value") == F.count("*"))
    return calls.groupBy(*keys).agg(F.when(same, F.min("value")).alias("value")).where("value is not null")


def deep_files(files: DataFrame, least: int) -> DataFrame:
    """Files nested at least so deep, the deepest first."""
    from ..functions.text import depth

    return files.select("path", depth("content").alias("depth")).where(F.col("depth") >= least).orderBy(F.desc("depth"), "path")


def rule_rows(log: DataFrame, prefix: str) -> DataFrame:
    """Rows of a rewrite log (rule, path, text) whose rule begins so."""
    return log.where(F.col("rule").startswith(prefix))


def bindings(log: DataFrame, kinds: DataFrame) -> DataFrame:
    """Rows of a rewrite log with the kind of binding that their rule writes (kinds: rule, kind)."""
    return log.join(kinds, "rule")


def refused_flags(checked: DataFrame) -> DataFrame:
    """Flags any of whose files (flag, path, reason) was refused, with files and reasons."""
    bad = checked.where("reason is not null")
    return bad.groupBy("flag").agg(F.array_sort(F.collect_set(F.struct(F.col("path").alias("file"), "reason"))).alias("refusal_reasons"))


def all_or_nothing(rewrites: DataFrame) -> DataFrame:
    """Rewrites of flags none of whose files was refused."""
    return rewrites.join(rewrites.where("reason is not null").select("flag").distinct(), "flag", "left_anti")


def binding_safe(uses: DataFrame) -> DataFrame:
    """path and name of constants bound once all of whose other uses are removable (path, name, binds, removable)."""
    ok = (F.count_if("binds") == 1) & F.bool_and(F.coalesce("removable", F.lit(False)) | F.col("binds"))
    return uses.groupBy("path", "name").agg(ok.alias("safe")).where("safe").drop("safe")


def withheld(uses: DataFrame) -> DataFrame:
    """Why constants are withheld, by the first rule that holds."""
    seen = uses.groupBy("path", "name").agg(F.count_if("binds").alias("b"), F.bool_and(F.coalesce("removable", F.lit(False)) | F.col("binds")).alias("ok"))
    reason = F.when(F.col("b") == 0, "never bound").when(F.col("b") > 1, "bound more than once").when(~F.col("ok"), "used where it can't be removed")
    return seen.select("path", "name", reason.alias("reason")).where("reason is not null")


def fused_names(rewrites: DataFrame) -> DataFrame:
    """Files whose rewrite has identifiers that their source never had."""
    return rewrites.select("flag", "path", tokens.fused(F.col("before"), F.col("after")).alias("names")).where(F.size("names") > 0)


def co_mentions(files: DataFrame, key: str, accessor: str) -> DataFrame:
    """Files that name both an accessor and the key."""
    c = F.col("content")
    return files.where(tokens.mentions_key(c, key, True) & tokens.mentions_any(c, [accessor], True))


def contradicting(entries: DataFrame, untreated: str) -> DataFrame:
    """Entries whose value is the literal that goes (path, entry, value)."""
    return entries.where(F.col("value") == untreated)


def stranded(bound: DataFrame, used: DataFrame) -> DataFrame:
    """Bindings (path, name) without any use left (used: path, name)."""
    return bound.join(used.select("path", "name").distinct(), ["path", "name"], "left_anti")


def judge(expect: Column, value: Column) -> Column:
    """What an assertion on a boolean literal says: true, false, or null for a matcher not known."""
    return F.when(expect.isin("toBeTruthy", "toBeTrue", "toBe(true)", "toEqual(true)", "assertTrue"), value).when(expect.isin("toBeFalsy", "toBeFalse", "toBe(false)", "toEqual(false)", "assertFalse"), ~value).when(expect.isin("toBeDefined", "not.toBeNull"), F.lit(True)).when(expect.isin("toBeUndefined", "toBeNull"), F.lit(False))


def unlisted_extensions(known: list[str], configured: list[str]) -> Column:
    return F.array_sort(F.array_except(F.array(*map(F.lit, known)), F.array(*map(F.lit, configured)).cast("array<string>")))
