"""After a removal was merged: which flags can be archived, and which removals wait.

No queue is stored. What is outstanding follows from the flags that live and the removals that were merged, each time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys
from .relational import _cut


def outstanding(live: DataFrame, merged: DataFrame, base: str) -> DataFrame:
    """Live flags (key) whose removal was merged into the base (branch, base, pull_request, url, merge_commit_sha): the last removal of each."""
    last = merged.where(F.col("base") == base).groupBy("branch").agg(F.max_by(F.struct("pull_request", "url", "merge_commit_sha"), "pull_request").alias("m"))
    flags = live.select("key").distinct().withColumn("branch", keys.removal_branch(F.col("key")))
    return flags.join(last, "branch").select("key", "branch", "m.*")


def by_containment(rows: DataFrame, refs: DataFrame, ancestry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose merge commit every ref contains, and the others with the first ref that doesn't (refs: ref, sha, seq; ancestry: sha, ancestor)."""
    wanted = rows.select("merge_commit_sha").distinct()
    held = refs.join(ancestry, "sha").select("ref", F.col("ancestor").alias("merge_commit_sha")).union(refs.select("ref", F.col("sha").alias("merge_commit_sha"))).join(wanted, "merge_commit_sha", "left_semi").distinct()
    names = refs.agg(F.array_sort(F.collect_list(F.struct("seq", "ref"))).alias("refs"))
    has = held.groupBy("merge_commit_sha").agg(F.collect_set("ref").alias("has"))
    each = rows.join(has, "merge_commit_sha", "left").join(F.broadcast(names))
    missing = F.filter("refs", lambda r: ~F.array_contains(F.coalesce("has", F.array().cast("array<string>")), r["ref"]))
    judged = each.withColumn("missing", F.get(F.transform(missing, lambda r: r["ref"]), F.lit(0))).drop("refs", "has")
    return judged.where("missing is null").drop("missing"), judged.where("missing is not null")


def _leapt(rows: DataFrame) -> DataFrame:
    """rows (sha, jump, d) with each jump doubled; d is how many steps it and what it stands on have."""
    ahead = rows.select(F.col("sha").alias("jump"), F.col("jump").alias("_jump"), F.col("d").alias("_d"))
    return rows.join(ahead, "jump", "left").select("sha", F.col("_jump").alias("jump"), (F.col("d") + F.coalesce("_d", F.lit(0))).alias("d"), *(c for c in rows.columns if c not in ("sha", "jump", "d")))


def chains(commits: DataFrame) -> DataFrame:
    """sha, parent (its first), chain and at (its place on it, from the oldest) of each commit of a history (sha, parent, and place of the parent if there is one).

    First parents make a forest. Of the children of a commit, that from which the longest line of first children goes on stays on its chain; so a main line is
    one chain, and a side branch is one more. Jumps along first parents double twice a round: a history of n commits takes log4(n) rounds for
    depths and lengths, and as many for chains. A history that goes round is an error.
    """
    spark = commits.sparkSession
    order = F.struct(F.col("place") if "place" in commits.columns else F.lit(0), "parent")
    first = commits.where("parent is not null").groupBy("sha").agg(F.min(order)["parent"].alias("parent"))
    every = commits.select("sha").union(commits.select("parent")).where("sha is not null").distinct()
    tree = _cut(spark, every.join(first, "sha", "left"))
    most = max(1, tree.count()).bit_length() // 2 + 1
    rows, step = tree.select("sha", F.col("parent").alias("jump"), F.col("parent").isNotNull().cast("int").alias("d"), F.lit(0).alias("h")), 1
    for _ in range(most):
        for _ in range(2):
            below = rows.where("jump is not null").groupBy("jump").agg(F.max(F.col("h") + step).alias("_h")).withColumnRenamed("jump", "sha")
            rows, step = _leapt(rows.join(below, "sha", "left").withColumn("h", F.greatest("h", "_h")).drop("_h")), step * 2
        rows = _cut(spark, rows)
        if rows.where("jump is not null").isEmpty():
            break
    else:
        raise ValueError("the history goes round")
    known = tree.join(rows.select("sha", F.col("d").alias("at"), "h"), "sha")
    heavy = known.where("parent is not null").groupBy("parent").agg(F.max(F.struct("h", "sha"))["sha"].alias("sha")).select("sha", F.lit(True).alias("stays"))
    known = _cut(spark, known.join(heavy, "sha", "left"))
    line = known.select("sha", F.coalesce(F.when(F.col("stays"), F.col("parent")), F.col("sha")).alias("chain"))
    for _ in range(most):
        for _ in range(2):
            line = line.join(line.select(F.col("sha").alias("chain"), F.col("chain").alias("_chain")), "chain").select("sha", F.col("_chain").alias("chain"))
        line = _cut(spark, line)
        ends = line.select("chain").distinct().join(line.withColumnRenamed("chain", "further"), F.col("chain") == F.col("sha"))
        if ends.where("further != chain").isEmpty():
            break
    return known.select("sha", "parent", "at").join(line, "sha")


def ancestry(commits: DataFrame, tips: DataFrame) -> DataFrame:
    """sha and ancestor for each tip (sha), over commits (sha, parent, and place of the parent if there is one).

    A tip reaches a chain up to its highest place reached (`chains`), so rounds go from chain to chain, not from commit to commit; each looks only at the
    stretch of a chain that is new to a tip.
    """
    spark = commits.sparkSession
    known = _cut(spark, chains(commits))
    place = lambda name: known.select(F.col("sha").alias(name), F.col("chain").alias(f"{name}_chain"), F.col("at").alias(f"{name}_at"))
    edges = commits.where("parent is not null").select("sha", "parent").distinct().join(place("sha"), "sha").join(place("parent"), "parent")
    across = _cut(spark, edges.where("sha_chain != parent_chain").select(F.col("sha_chain").alias("chain"), F.col("sha_at").alias("leaves"), F.col("parent_chain").alias("to"), F.col("parent_at").alias("lands")))
    reach = fresh = _cut(spark, tips.select("sha").distinct().join(known, "sha").select(F.col("sha").alias("tip"), "chain", F.lit(-1).alias("low"), F.col("at").alias("high")))
    while True:
        met = fresh.join(across, "chain").where("leaves > low AND leaves <= high").groupBy("tip", F.col("to").alias("chain")).agg(F.max("lands").alias("high"))
        had = reach.groupBy("tip", "chain").agg(F.max("high").alias("low"))
        fresh = _cut(spark, met.join(had, ["tip", "chain"], "left").select("tip", "chain", F.coalesce("low", F.lit(-1)).alias("low"), "high").where("high > low"))
        if fresh.isEmpty():
            break
        reach = reach.union(fresh)
    top = reach.groupBy("tip", "chain").agg(F.max("high").alias("high"))
    return known.join(top, "chain").where("at <= high AND sha != tip").select(F.col("tip").alias("sha"), F.col("sha").alias("ancestor"))


def deployed(events: DataFrame, environment: str) -> DataFrame:
    """Successful deployments to an environment; state and environment in any case."""
    return events.where((F.lower("state") == "success") & (F.lower("environment") == environment.lower()))


def archive_each(rows: DataFrame, send: Callable[[str], str], stop_on: tuple[str, ...] = ("unauthorized",)) -> list[tuple[str, str]]:
    """Archive rows one by one, in order of key: (key, outcome). An error is one row's outcome; after an outcome of stop_on the rest is `not-attempted`. Rows come to the driver one partition at a time."""
    out, stopped = [], False
    for row in rows.select("key").distinct().orderBy("key").toLocalIterator():
        if stopped:
            out.append((row.key, "not-attempted"))
            continue
        try:
            outcome = send(row.key)
        except Exception as error:
            outcome = f"failed: {error}"
        out.append((row.key, outcome))
        stopped = outcome in stop_on
    return out


# Markers in comments, and the commands that a comment can give.
HOLD_MARKER = r"<!-- flag-hold draft=(true|false) -->"
RELEASE_MARKER = "<!-- flag-release -->"
COMMAND_PREFIX = "@sievewright"
COMMANDS = ("rerun", "recreate")


def active_holds(comments: DataFrame) -> DataFrame:
    """pull and was_draft of each request that is on hold: the last marker in a trusted comment by time decides (pull, trusted, created_at, body)."""
    draft = F.regexp_extract("body", HOLD_MARKER, 1)
    marks = comments.where("trusted").withColumn("draft", draft).where((F.col("draft") != "") | F.contains("body", F.lit(RELEASE_MARKER)))
    last = marks.groupBy("pull").agg(F.max_by("draft", F.struct("created_at", "draft")).alias("draft"))
    return last.where("draft != ''").select("pull", (F.col("draft") == "true").alias("was_draft"))


def command(body: Column, mention: str = COMMAND_PREFIX) -> Column:
    """The command of a comment: a whole line of the mention and a known verb, in any case, outside fenced and indented code and HTML comments; null without one."""
    shown = F.regexp_replace(body, r"(?s)<!--.*?(-->|$)", "")
    shown = F.regexp_replace(shown, r"(?ms)^[ ]{0,3}(`{3,}|~{3,})[^\n]*\n.*?(^[ ]{0,3}\1[`~]*[ \t]*$|\z)", "")
    found = F.regexp_extract(shown, rf"(?im)^[ ]{{0,3}}{mention}[ \t]+({'|'.join(COMMANDS)})[ \t]*\r?$", 1)
    return F.when(found != "", F.lower(found))
