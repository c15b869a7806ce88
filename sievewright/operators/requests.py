"""Open removal requests: which to put on hold or release, and what comments on them ask for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import keys
from . import archive

#: Rights that let a commenter give commands.
WRITERS = ("admin", "maintain", "write")


def _names(c: str):
    return F.concat(F.lit("`"), F.array_join(c, "`, `"), F.lit("`"))


def hold_actions(pulls: DataFrame, comments: DataFrame) -> DataFrame:
    """What to do with each open request (pull, key, draft, blocked_by, comments_read): pull, key, action, set_draft and body.

    A request whose flag live flags need as a prerequisite is held: it becomes a draft, and a comment says what it was. Once
    none does, it is released: ready again unless it was a draft before. A held request that someone marked ready is left
    ("ready-by-hand"), as is one whose comments couldn't be read ("unread"). Nulls of draft and blocked_by are false and none.
    """
    held = archive.active_holds(comments)
    rows = pulls.join(held, "pull", "left").withColumn("draft", F.coalesce("draft", F.lit(False)))
    blocked, on_hold = F.size(F.coalesce("blocked_by", F.array().cast("array<string>"))) > 0, F.col("was_draft").isNotNull()
    action = (
        F.when(~F.coalesce("comments_read", F.lit(True)), F.when(blocked, "unread"))
        .when(blocked & ~on_hold, "hold")
        .when(blocked & ~F.col("draft"), "ready-by-hand")
        .when(~blocked & on_hold, "release")
    )
    rows = rows.withColumn("action", action).where("action is not null")
    ready = (F.col("action") == "release") & F.col("draft") & ~F.col("was_draft")
    set_draft = F.when((F.col("action") == "hold") & ~F.col("draft"), True).when(ready, False)
    marker = F.concat(F.lit("<!-- flag-hold draft="), F.col("draft").cast("string"), F.lit(" -->"))
    state = F.when(F.col("draft"), "It was a draft already and stays one.").otherwise("It is a draft until then.")
    hold = F.concat(F.lit("On hold: flag `"), F.col("key"), F.lit("` is still a prerequisite of "), _names("blocked_by"), F.lit(". "), state, F.lit("\n\n"), marker)
    free = F.concat(F.lit("Released: no live flag needs `"), F.col("key"), F.lit("` any more."), F.when(ready, " The request is ready again.").otherwise(""), F.lit(f"\n\n{archive.RELEASE_MARKER}"))
    return rows.select("pull", "key", "action", set_draft.alias("set_draft"), F.when(F.col("action") == "hold", hold).when(F.col("action") == "release", free).alias("body"))


def apply_holds(actions: DataFrame, set_draft: Callable[[int, bool], bool], comment: Callable[[int, str], bool]) -> list[tuple[int, str]]:
    """Carry out holds and releases in order of pull; pull and outcome of each. Open requests alone come here, so they are few.

    The draft comes first, so a comment never tells of what didn't happen; a draft that no comment could record is undone.
    """
    out = []
    for r in actions.where("body is not null").orderBy("pull").toLocalIterator():
        if r.set_draft is not None and not set_draft(r.pull, r.set_draft):
            out.append((r.pull, "refused"))
        elif comment(r.pull, r.body):
            out.append((r.pull, r.action))
        else:
            if r.action == "hold" and r.set_draft:
                set_draft(r.pull, False)
            out.append((r.pull, "no-comment"))
    return out


def commanded(comments: DataFrame, pulls: DataFrame) -> DataFrame:
    """comment_id, pull, key and action of each comment (comment_id, pull, permission, body) on requests (pull, branch).

    action is the command, or why there is none: not-a-pull-request, not-a-command, not-permitted (no reply is due to those
    without rights) or not-a-removal (the branch names no flag).
    """
    verb, key = archive.command(F.col("body")), keys.key_of_branch(F.col("branch"))
    known = pulls.select("pull", "branch", F.lit(True).alias("known"))
    rows = comments.join(known, "pull", "left").withColumn("verb", verb).withColumn("key", key)
    action = (
        F.when(F.col("known").isNull(), "not-a-pull-request")
        .when(F.col("verb").isNull(), "not-a-command")
        .when(~F.coalesce(F.col("permission").isin(*WRITERS), F.lit(False)), "not-permitted")
        .when(F.col("key").isNull(), "not-a-removal")
        .otherwise(F.col("verb"))
    )
    return rows.select("comment_id", "pull", "key", action.alias("action"))


def asked(candidates: DataFrame, commands: DataFrame) -> DataFrame:
    """The candidates that a command asks to run again, each once."""
    return candidates.join(commands.where(F.col("action").isin(*archive.COMMANDS)).select("key").distinct(), "key", "left_semi")
