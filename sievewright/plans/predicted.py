"""The branches that a fold will delete, found before it runs, and whether it did.

A prediction lets checks leave out what stands in such a branch; it is only good if the fold keeps it. So every predicted
stretch is held against the stretches that went (an interval anti join), and every mention outside all of them is reported. Predicted is the plainest shape: an if whose
condition the reads decide, and whose branch that goes has braces.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scanner import Tokens, Unreadable, closing, scan
from ..operators import relational
from ..sources.config import Accessor
from .fold import FOLDED, MARKUP, Refused, _simplify, fold_reads, places


def _copied(tokens: Tokens, a: int, b: int) -> Tokens:
    from ..functions.scanner import Token

    out = Tokens(Token(t.kind, t.text, t.gap) for t in tokens[a:b])
    out.dialect, out.language = tokens.dialect, tokens.language
    return out


def dead_blocks(source: str, key: str, value: bool, accessors: Sequence[Accessor], language: str) -> list[tuple[int, int]]:
    """Stretches of the blocks, braces included, that the fold of a key will delete."""
    tokens, _ = scan(source, language in MARKUP, language)
    tokens.language = language
    at, out = places(tokens), []
    for k in range(len(tokens) - 1):
        if tokens[k].text != "if" or tokens[k].kind != "id":
            continue
        if tokens[k + 1].text == "(" and language not in ("go", "swift"):
            a, b = k + 2, closing(tokens, k + 1)
            body = b + 1
        elif language in ("go", "swift"):
            a = k + 1
            b = body = next((x for x in range(a, len(tokens)) if tokens[x].text == "{"), len(tokens))
        else:
            continue
        condition = _copied(tokens, a, b)
        try:
            if not fold_reads(condition, key, value, list(accessors), []):
                continue
            _simplify(condition, key)
        except (Refused, Unreadable, IndexError):
            continue
        if len(condition) != 1 or condition[0].value is None or body >= len(tokens) or tokens[body].text != "{":
            continue
        end = closing(tokens, body)
        if not condition[0].value:
            out.append((at[body][0], at[end][1]))
        elif end + 2 < len(tokens) and tokens[end + 1].text == "else" and tokens[end + 2].text == "{":
            out.append((at[end + 2][0], at[closing(tokens, end + 2)][1]))
    return out


def spans(files: DataFrame, accessors: Sequence[Accessor], columns: Sequence[str] = ("flag", "path")) -> DataFrame:
    """The predicted blocks of files (code_key, treatment, language, before; columns are kept): start and end, a row each, from a table function."""
    reads = list(accessors)

    class Blocks:
        def eval(self, source: str, key: str, value: bool, language: str):
            try:
                if source is not None and language in FOLDED:
                    yield from dead_blocks(source, key, bool(value), reads, language)
            except (Unreadable, IndexError, RecursionError):
                return

    table = F.udtf(Blocks, returnType="start: int, end: int")
    return relational.dealt(files, *columns).lateralJoin(table(F.col("before").outer(), F.col("code_key").outer(), F.col("treatment").outer(), F.col("language").outer())).select(*columns, "start", "end")


def unkept(predicted: DataFrame, done: DataFrame) -> DataFrame:
    """Predicted blocks (flag, path, start, end) of which something is left: no stretch that went (done: `remove.folded`) holds them whole."""
    went = done.select("flag", "path", F.explode("gone").alias("g")).select("flag", "path", F.col("g.start").alias("from"), F.col("g.end").alias("to"))
    file = lambda df: df.withColumn("file", F.to_json(F.struct("flag", "path")))
    held = relational.contained(file(predicted).drop("flag", "path"), file(went).drop("flag", "path"), "file", "start", "from", "to").where(F.col("end") <= F.col("to")).select("file", "start", "end")
    return file(predicted).join(held, ["file", "start", "end"], "left_anti").drop("file")


def mentions(files: DataFrame, name: str | Column = "code_key") -> DataFrame:
    """flag, path and at of each place of a name in files (before), as a token; places count from 0."""
    name = F.col(name) if isinstance(name, str) else name
    quoted = F.concat(F.lit("(?<![A-Za-z0-9_$])\\Q"), name, F.lit("\\E(?![A-Za-z0-9_$])"))
    pieces = F.split("before", quoted)
    before = F.aggregate(F.slice(pieces, F.lit(1), F.col("i")), F.lit(0), lambda n, x: n + F.length(x))
    found = files.where(F.regexp_like("before", quoted)).withColumn("i", F.explode(F.sequence(F.lit(1), F.size(pieces) - 1)))
    return found.select("flag", "path", (before + (F.col("i") - 1) * F.length(name)).alias("at"))


def reported(files: DataFrame, predicted: DataFrame, name: str | Column = "code_key") -> DataFrame:
    """Mentions (flag, path, at) that no predicted block holds: they keep what they name."""
    file = lambda df: df.withColumn("file", F.to_json(F.struct("flag", "path")))
    return relational.outside(file(mentions(files, name)), file(predicted).select("file", "start", "end"), "file", "at", "start", "end").drop("file")
