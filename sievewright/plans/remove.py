"""The removal run: candidates and files in, rewrites, findings, diffs and results out.

Each (flag, file) pair is folded in a row of its own, so one flag with very many files is spread like many flags with few.
A flag any of whose files is refused loses all of its rewrites.
"""

from __future__ import annotations

import ast
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import comments, tokens
from ..functions.scanner import Unreadable, scan
from ..operators import agreement, candidates, mentions, relational, report
from ..sources import checkout
from ..sources.config import Accessor, Gate
from . import fold as one
from . import parameters, python_fold, symbols, wrappers
from .alike import alike

_FOLDED = "flag string, path string, before string, after string, reads int, reason string, findings array<struct<line:int,kind:string,reason:string>>, left int, made array<struct<name:string,form:string,value:boolean>>, gone array<struct<start:int,end:int>>"
_ARROW = pa.schema({
    **dict.fromkeys(("flag", "path", "before", "after"), pa.string()), "reads": pa.int32(), "reason": pa.string(), "findings": pa.list_(pa.struct({"line": pa.int32(), "kind": pa.string(), "reason": pa.string()})), "left": pa.int32(),
    "made": pa.list_(pa.struct({"name": pa.string(), "form": pa.string(), "value": pa.bool_()})), "gone": pa.list_(pa.struct({"start": pa.int32(), "end": pa.int32()})),
})


def pairs(open_candidates: DataFrame, files: DataFrame) -> DataFrame:
    """flag, key, treatment, path, language and before for each file (path, content as text) that names the flag's spelling as a token."""
    found = mentions.mention_files(files, open_candidates.select(F.col("code_key").alias("name")), tokens.KEY, texts=True)
    met = found.where("name is not null").join(relational.small(open_candidates.select(F.col("code_key").alias("name"), F.col("key").alias("flag"), "treatment")), "name")
    return met.select("flag", F.col("name").alias("code_key"), "treatment", "path", checkout.language(F.col("path")).alias("language"), F.col("content").alias("before"))


def _one(source: str, key: str, value: bool, language: str, reads: list[Accessor], gates: list[Gate], inert: list[str], known: list[one.Known]) -> tuple[str, int, str | None, list, int, list, list]:
    """after, reads, reason, findings, uses left, names made and stretches gone of one file in a language with braces."""
    after, unwrapped, lost = source, 0, []
    if gates and language in one.MARKUP:
        after, unwrapped = wrappers.unwrap_gates(source, key, value, gates)
    done = one.fold(after, key, value, reads, language, known)
    after, n = done.after, done.reads + unwrapped
    if not n:
        return source, 0, None, done.findings, done.left, [], []
    if inert:
        after, lost = wrappers.without_calls(after, inert, language, before=source)
    after = comments.tidy(after, key, language in one.MARKUP, language)
    return after, n, one.refusal(source, after, language), [*done.findings, *((None, "call-removed", x) for x in lost)], done.left, done.made, done.gone if not unwrapped else []


def _readable(source: str, language: str) -> bool:
    """Whether a source scans, or parses, itself: then what doesn't is a rewrite of it."""
    try:
        ast.parse(source) if language == "python" else scan(source, language in one.MARKUP, language)
    except (Unreadable, SyntaxError):
        return False
    return True


def folded(rows: DataFrame, accessors: Sequence[Accessor], gates: Sequence[Gate] = (), inert: Sequence[str] = (), keep: Sequence[str] = (), sites: bool = False) -> DataFrame:
    """The fold of each pair: after (before where nothing changed), reads (gates among them), reason (why it is refused) and findings.

    gates: components of markup that show their children by a flag. inert: functions without effects, whose calls go where the fold made them constant.
    rows may have `known`, names that stand for the key or for what was served; left counts their uses that stay, and made has the names at the top of
    the file that stand for a literal now. gone: the stretches of the source that went, in languages with braces. keep: columns of rows that are handed on.
    sites: `parameters.tally` of what was rewritten too, in scripts; of all results where rows' `source` is kept.
    """
    reads, shown, idle = list(accessors), list(gates), list(inert)

    columns = ["flag", "path", "before", "code_key", "treatment", "language", *(["known"] if "known" in rows.columns else [])]

    def run(batches):
        def braced(source, key, value, language, known):
            done = _one(source, key, value, language, reads, shown, idle, known)
            return (*done, parameters.tally(done[0], language) if sites and language in one.SCRIPTS and not done[2] and ("source" in keep or done[0] != source) else [])

        if not idle:  # calls without effects are told apart by their numbers too
            braced = alike(braced, [*map(repr, reads), *map(repr, shown)])
        for batch in batches:
            out = []
            told = [batch.column(c).to_pylist() if c == "known" else symbols.values(batch.column(c)) for c in columns[2:]]
            for before, key, treatment, language, *names in zip(*told, strict=True):
                after, n, reason, findings, left, made, gone, sited = before, 0, None, [], 0, [], [], []
                known = tuple(one.Known(x["name"], x["member"], x["form"], x["value"]) for x in (names[0] if names and names[0] else ()))
                try:
                    if language in one.FOLDED:
                        after, n, reason, findings, left, made, gone, sited = braced(before, key, bool(treatment), language, known)
                    elif language == "python":
                        done = python_fold.fold(before, key, bool(treatment), reads, known)
                        after, n, findings, left, made = done.after, done.reads, done.findings, done.left, done.made
                except (Unreadable, SyntaxError) as e:
                    if _readable(before, language):
                        after, reason = before, f"the rewrite does not scan: {e}"
                    else:
                        findings = [(None, "unreadable", "the file was left: it does not scan")]
                except (one.Refused, RecursionError) as e:
                    after, reason = before, str(e) or "nested too deep"
                if reason:
                    made, gone, sited = [], [], []
                out.append((after, n, reason, findings, left, made, gone, sited))
            made = dict(zip([*_ARROW.names[3:], "sites"], zip(*out, strict=True) if out else [()] * 8, strict=True))
            kept = {c: batch.column(c).cast(pa.string()) for c in columns[:3]}
            handed = {c: batch.column(c) for c in keep} | ({"sites": symbols.column(made["sites"], parameters.ARROW)} if sites else {})
            columns_ = [kept[x.name] if x.name in kept else symbols.column(made[x.name], x.type) for x in _ARROW]
            yield pa.RecordBatch.from_arrays([*columns_, *handed.values()], schema=pa.schema([*_ARROW, *(pa.field(c, x.type) for c, x in handed.items())]))

    schema = StructType([*StructType.fromDDL(_FOLDED), *(rows.schema[c] for c in keep), *StructType.fromDDL(f"sites {parameters.TALLY}" if sites else "")])
    return relational.dealt(rows.select(*columns, *keep), "flag", "path").mapInArrow(run, schema)


def run(rows: DataFrame, files: DataFrame, accessors: Sequence[Accessor], ignore: Sequence[str] = (), allow: Sequence[str] = (), aliases: dict[str, str] | None = None, known: DataFrame | None = None, handled: DataFrame | None = None, max_prs: int = 0, gates: Sequence[Gate] = (), inert: Sequence[str] = (), follow: bool = True, index: DataFrame | None = None) -> dict[str, DataFrame]:
    """A dry run over candidates and files (path, content as text): tables results, rewrites and findings.

    follow: names that hold the key or became what was served are followed through imports, in scripts and Python, over the whole corpus. index: the symbols
    of the files where they are stored (`symbols.indexed`).
    """
    decided = candidates.decide(rows, list(ignore), list(allow), aliases, known, handled)
    open_, done = decided.where("action is null"), None
    met = pairs(open_, files)
    if follow:
        from . import spread  # it folds by this module

        named = files.withColumn("language", checkout.language(F.col("path"))).where(F.col("language").isin(*spread.FOLLOWED))
        table, held = index, None
        if index is None:
            held = relational.checkpointed(parameters.read(named, list(accessors)))
            table = held.select("path", F.inline("symbols"))
        done = spread.followed(open_.select("key", "code_key", "treatment"), met, files, table, accessors, gates, inert, held)
    else:
        done = relational.checkpointed(folded(met, accessors, gates, inert))
    kept = agreement.all_or_nothing(done)
    rewrites = kept.where("after != before and reads > 0").select("flag", "path", "before", "after")
    # A file that still names the flag outside comments, or that can't be judged, is reported.
    left = kept.select("flag", "path", F.when(F.col("reads") > 0, F.col("after")).otherwise(F.col("before")).alias("content"))
    left = left.join(decided.select(F.col("key").alias("flag"), "code_key"), "flag")
    named = F.regexp_like("content", F.concat(F.lit(f"(?<![{tokens.KEY}])\\Q"), F.col("code_key"), F.lit(f"\\E(?![{tokens.KEY}])")))
    still = left.where(named).withColumn("quiet", F.when(checkout.language(F.col("path")).isin(*one.FOLDED), comments.comment_only(F.col("content"), F.col("code_key"), checkout.language(F.col("path")))))
    unprocessed = still.where(~F.coalesce("quiet", F.lit(False))).groupBy("flag").agg(F.array_sort(F.collect_set("path")).alias("unprocessed_files"))
    lines = still.where("quiet").select("flag", "path", "code_key", F.posexplode(F.split("content", "\n", -1)).alias("at", "text")).where(F.contains("text", "code_key"))
    kept_comments = lines.groupBy("flag").agg(F.array_sort(F.collect_set(F.struct("path", (F.col("at") + 1).alias("line"), F.trim("text").alias("text")))).alias("kept_comments"))
    refused = agreement.refused_flags(done)
    diffs = report.flag_diffs(rewrites)
    key = lambda df: df.withColumnRenamed("flag", "key")
    results = decided.withColumnRenamed("action", "early")
    for part in (diffs, refused, unprocessed, kept_comments):
        taken = key(part).withColumn("early", F.lit(None).cast("string"))
        results = results.join(taken, (results["key"] == taken["key"]) & results["early"].isNull(), "left").drop(taken["key"], taken["early"])
    action = F.coalesce("early", F.when(F.col("refusal_reasons").isNotNull(), "unsafe-rewrite").otherwise("dry-run"))
    results = results.select("key", "treatment", "status", F.when(action == "dry-run", F.coalesce("diff", F.lit(""))).otherwise("").alias("diff"), action.alias("action"), F.lit(None).cast("string").alias("pr_url"), "unprocessed_files", "kept_comments", F.transform("refusal_reasons", lambda r: r["file"]).alias("refused_files"), "refusal_reasons", "blocked_by", "seq")
    findings = done.select("flag", "path", F.explode("findings").alias("f")).select("flag", "path", "f.line", "f.kind", "f.reason", F.lit(None).cast("string").alias("text"))
    return {"results": candidates.up_to(results, max_prs), "rewrites": rewrites, "findings": findings}


def restored(before: DataFrame, after: DataFrame) -> DataFrame:
    """Paths whose bytes differ between two snapshots (path, content), or that only one has; an undone run has none."""
    a, b = (x.select("path", F.sha2(F.col("content").cast("binary"), 256).alias(n)) for x, n in ((before, "a"), (after, "b")))
    return a.join(b, "path", "full").where(~F.col("a").eqNullSafe(F.col("b"))).select("path")


def write(rewrites: DataFrame, path: str) -> None:
    """The rewrites, one folder for each flag; a run that is repeated replaces the folders of its own flags alone."""
    rewrites.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("flag").parquet(path)
