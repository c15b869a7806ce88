"""Which files name which keys, and what kind of mention it is.

The join is on tokens: each text is cut into its distinct tokens of a character class, and names are met by equality. A
name of several tokens is met by its longest one and then searched for in the texts that hold that. Names without any
token, and up to FEW names of any kind, are searched for in each text, BLOCK names in a pass.
A file whose content is null can't be read, so it may name anything: it comes back with a null name.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import islice

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tokens
from .relational import _cut, closure, first_by

#: So many names are searched for in each text, which is cheaper than cutting the text into tokens.
FEW = 32
#: Names searched for in one pass.
BLOCK = 1000


def mention_files(files: DataFrame, names: DataFrame, inside: str = tokens.IDENTIFIER, path: str = "path", content: str = "content", texts: bool = False) -> DataFrame:
    """path and name for each file and each name (a table of name) that it mentions as a token; name is null for an unreadable file. An empty name is mentioned nowhere. texts: the content too."""
    distinct = names.select("name").where(F.col("name") != "").distinct()
    text = files.select(path, content).where(F.col(content).isNotNull())
    quoted = F.concat(F.lit(f"(?<![{inside}])\\Q"), F.col("name"), F.lit(f"\\E(?![{inside}])"))
    first = [r.name for r in distinct.limit(FEW + 1).collect()]
    if len(first) <= FEW:
        found = _searched(text, [first], quoted, path, content)
        return found.unionByName(_unread(files, path, content), allowMissingColumns=True) if texts else found.drop(content).union(_unread(files, path, content))
    parts = F.regexp_extract_all("name", F.lit(f"([{inside}]+)"), F.lit(1))
    longest = F.array_max(F.transform(parts, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    keyed = distinct.withColumn("token", longest)
    keyed = _cut(names.sparkSession, keyed)  # several passes read the names, which may come from all texts
    kinds = keyed.agg(F.max(F.col("token").isNull()).alias("bare"), F.max(F.col("token") != F.col("name")).alias("several")).first()
    cut = text.select(path, F.explode(tokens.tokens(F.col(content), inside)).alias("token"))
    found = cut.join(keyed.where("token = name"), "token").select(path, "name")
    if kinds.several:
        met = cut.join(keyed.where("token != name"), "token").select(path, "name").join(text, path)
        found = found.union(met.where(F.regexp_like(content, quoted)).select(path, "name"))
    if kinds.bare:
        bare = keyed.where("token is null").select("name").toLocalIterator()
        blocks = iter(lambda: [r.name for r in islice(bare, BLOCK)], [])
        found = found.union(_searched(text, blocks, quoted, path, content).drop(content))
    if texts:
        found = found.join(text, path)
    return found.unionByName(_unread(files, path, content), allowMissingColumns=texts)


def _searched(text: DataFrame, blocks: Iterable[list[str]], quoted: Column, path: str, content: str) -> DataFrame:
    """path, name and content of each name of the blocks in each text."""
    out = text.select(path, F.lit(None).cast("string").alias("name"), content).where("false")
    for names in blocks:
        hits = F.filter(F.array(*map(F.lit, names)).cast("array<string>"), lambda n: F.contains(F.col(content), n))
        out = out.union(text.select(path, content, F.explode(hits).alias("name")).where(F.regexp_like(content, quoted)).select(path, "name", content))
    return out


def _unread(files: DataFrame, path: str, content: str) -> DataFrame:
    return files.where(F.col(content).isNull()).select(path, F.lit(None).cast("string").alias("name"))


def mention_count(files: DataFrame, names: DataFrame, inside: str = tokens.KEY, path: str = "path", content: str = "content") -> DataFrame:
    """Files that mention each name; unreadable files count for every name."""
    found = mention_files(files, names, inside, path, content)
    unread = found.where("name is null").agg(F.count("*").alias("unread"))
    counts = names.select("name").distinct().join(found.where("name is not null").groupBy("name").agg(F.count("*").alias("n")), "name", "left")
    return counts.join(F.broadcast(unread)).select("name", (F.coalesce("n", F.lit(0)) + F.col("unread")).alias("n")).orderBy(F.desc("n"), "name")


def with_aliases(names: DataFrame, renames: DataFrame) -> DataFrame:
    """names and every name they are exported again under (renames: original, alias), to the end."""
    return closure(renames.select(F.col("original").alias("src"), F.col("alias").alias("dst")), names.select(F.col("name").alias("node"))).withColumnRenamed("node", "name")


def elsewhere(constants: DataFrame, files: DataFrame) -> DataFrame:
    """constants (path, name) with `elsewhere`: whether another file names it; an unreadable other file counts.

    Of the files that name a constant the first and the last path are kept: one that isn't its own is another's, so no constant meets all of its mentions.
    """
    ends = (F.min("path").alias("_lo"), F.max("path").alias("_hi"))
    named = mention_files(files.where(F.col("content").isNotNull()), constants.select("name")).groupBy("name").agg(*ends)
    blind = files.where(F.col("content").isNull()).agg(F.min("path").alias("_first"), F.max("path").alias("_last"))
    other = [F.coalesce(F.col(c) != F.col("path"), F.lit(False)) for c in ("_lo", "_hi", "_first", "_last")]
    met = constants.join(named, "name", "left").crossJoin(F.broadcast(blind))
    return met.select(*constants.columns, (other[0] | other[1] | other[2] | other[3]).alias("elsewhere"))


def referenced_elsewhere(constants: DataFrame, files: DataFrame) -> DataFrame:
    """Constants (path, name) that another file names; an unreadable other file counts."""
    return elsewhere(constants, files).where("elsewhere").select("path", "name").distinct()


def unnamed_elsewhere(constants: DataFrame, files: DataFrame) -> DataFrame:
    return elsewhere(constants, files).where("not elsewhere").drop("elsewhere")


def unprocessed(references: DataFrame, skipped: DataFrame) -> DataFrame:
    """Files still in question (path, resolved, seq): what mentions the flag, then what was skipped, one row for each resolved path under its first spelling."""
    both = references.select("path", "resolved", "seq", F.lit(0).alias("source")).union(skipped.select("path", "resolved", "seq", F.lit(1).alias("source")))
    return first_by(both, ["resolved"], ["source", "seq", "path"]).select("path", "resolved")


def live_references(files: DataFrame, key: str, inert: Column) -> DataFrame:
    """Files with a live mention: all but those in which every mention is inert. What can't be read or judged counts as live."""
    return files.where(F.coalesce(tokens.mentions_key(F.col("content"), key) & ~inert, F.lit(True)))


def first_lines(files: DataFrame, needles: DataFrame) -> DataFrame:
    """path, name, line and text of the first line of each file that holds each needle (a table of path, name)."""
    split = files.join(needles, "path").select("path", "name", F.posexplode(F.split("content", "\n", -1)).alias("at", "text"))
    hits = split.where(F.contains("text", "name"))
    return hits.groupBy("path", "name").agg(F.min(F.struct("at", "text")).alias("f")).select("path", "name", (F.col("f.at") + 1).alias("line"), F.col("f.text").alias("text"))
