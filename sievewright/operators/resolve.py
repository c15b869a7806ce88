"""Declarations, references, and the proof that a declaration can go.

Every step is closed to the safe side: what can't be decided keeps the declaration.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .mentions import mention_files
from .relational import _cut, nearest, unique

NAME = ["module", "owner", "name"]


def resolve(declarations: DataFrame, references: DataFrame, files: DataFrame) -> dict[str, DataFrame]:
    """What becomes of key declarations (path, module, owner, name, key): tables deletable, blocked (with reason) and readers.

    A declaration is deletable if its qualified name is declared once, every file that mentions its name as a token is
    readable and holds a resolved reference of it (path, module, owner, name, removable) or is its own, and all of its references are removable.
    """
    d = declarations.select("path", *NAME, "key").distinct()
    lone = unique(d, NAME)
    doubled = d.join(lone.select(*NAME), NAME, "left_anti").withColumn("reason", F.lit("declared more than once"))
    mentions = mention_files(files, lone.select("name").distinct())
    named = lone.join(mentions.where("name is not null").withColumnRenamed("path", "other"), "name").where("other != path")
    proven = references.groupBy(F.col("path").alias("other"), *NAME).agg(F.bool_and(F.coalesce("removable", F.lit(False))).alias("_ok"))
    judged = named.join(proven, ["other", *NAME], "left").groupBy("path", *NAME).agg(F.bool_and(F.coalesce("_ok", F.lit(False))).alias("_all"))
    own = references.groupBy("path", *NAME).agg(F.bool_and(F.coalesce("removable", F.lit(False))).alias("_own"))
    unread = not files.where(F.col("content").isNull()).isEmpty()
    rows = lone.join(judged, ["path", *NAME], "left").join(own, ["path", *NAME], "left")
    ok = F.coalesce("_all", F.lit(True)) & F.coalesce("_own", F.lit(True)) & F.lit(not unread)
    rows = rows.withColumn("_free", ok)
    reason = F.when(F.lit(unread), "a file can't be read").when(~F.coalesce("_all", F.lit(True)), "a mention isn't proven").otherwise("a use in its own file stays")
    deletable = rows.where("_free").select("path", *NAME, "key")
    blocked = rows.where("not _free").select("path", *NAME, "key", reason.alias("reason")).unionByName(doubled)
    readers = references.join(deletable.select(*NAME), NAME, "left_semi")
    return {"deletable": deletable, "blocked": blocked, "readers": readers}


def competing(declarations: DataFrame) -> DataFrame:
    """Declarations whose name another file declares too."""
    spread = declarations.groupBy("name").agg(F.min("path").alias("lo"), F.max("path").alias("hi")).where("lo < hi").select("name")
    return declarations.join(spread, "name", "left_semi")


def void_readers(readers: DataFrame, blocked: DataFrame) -> DataFrame:
    """Readers without those of declarations that stay."""
    return readers.join(blocked.select(*NAME).distinct(), NAME, "left_anti")


def survivors(after: DataFrame, deleted: DataFrame) -> DataFrame:
    """Rewritten files that still name something deleted (a table of name); must be empty."""
    return mention_files(after, deleted.select("name").distinct())


def uncovered(uses: DataFrame, covered: DataFrame) -> DataFrame:
    """Uses (path, ...) in files that no parser covers (a table of path): they block their declarations."""
    return uses.join(covered.select("path").distinct(), "path", "left_anti")


def candidate_files(mentions: DataFrame, readers: DataFrame, callers: DataFrame, claims: DataFrame) -> DataFrame:
    """Files that a run may write: own mentions, cross-file readers and callers, without what others claim."""
    every = mentions.select("path").union(readers.select("path")).union(callers.select("path")).distinct()
    return every.join(claims.select("path").distinct(), "path", "left_anti")


def provider(imports: DataFrame, exports: DataFrame) -> DataFrame:
    """reader, name and the module that declares it, over chains of re-exports (exports: module, name, source; source null where it declares). Null for a chain that ends nowhere or goes round; no rename is followed.

    Each round doubles the reach of every re-export, so a chain of n takes log2(n) rounds.
    """
    one = exports.groupBy("module", "name").agg(F.min("source").alias("source"), F.bool_or(F.col("source").isNull()).alias("here"))
    hop = _cut(exports.sparkSession, one.select("module", "name", F.when(~F.col("here"), F.col("source")).alias("to"), F.when(F.col("here"), F.col("module")).alias("declared")))
    rounds = max(1, hop.count()).bit_length()
    for _ in range(rounds):  # what still has a way to go after as many goes round
        if hop.where("to is not null").isEmpty():
            break
        ahead = hop.select(F.col("module").alias("to"), "name", F.col("to").alias("_to"), F.col("declared").alias("_declared"))
        hop = _cut(hop.sparkSession, hop.join(ahead, ["to", "name"], "left").select("module", "name", F.col("_to").alias("to"), F.coalesce("declared", "_declared").alias("declared")))
    return imports.select("reader", "name", "module").join(hop.select("module", "name", "declared"), ["module", "name"], "left").select("reader", "name", F.col("declared").alias("module"))


def workspace_source(imports: DataFrame, packages: DataFrame) -> DataFrame:
    """The source file of bare specifiers (reader, specifier): the package of the longest name that the specifier starts with, as a whole path part (packages: package, source)."""
    parts = F.split("specifier", "/")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    met = imports.withColumn("package", F.explode(heads)).join(packages, "package")
    best = met.groupBy("reader", "specifier").agg(F.max_by(F.struct("package", "source"), F.length("package")).alias("p"))
    return imports.join(best.select("reader", "specifier", F.col("p.source").alias("source")), ["reader", "specifier"], "left")


def modules_of(files: DataFrame, modules: DataFrame) -> DataFrame:
    """files (path) with the module of the nearest module file above them (directory, module)."""
    return nearest(files, modules, "path", "directory", "module")


def visible(constants: DataFrame) -> DataFrame:
    """Constants that another file could name."""
    return constants.where(F.coalesce(F.col("exported"), F.lit(True)))


def held_tables(loads: DataFrame) -> DataFrame:
    """Exported tables (module, name) that some importer reads by anything but a literal key, with the reason (loads: module, name, literal)."""
    judged = loads.groupBy("module", "name").agg(F.bool_and(F.coalesce("literal", F.lit(False))).alias("ok"))
    return judged.where("not ok").select("module", "name", F.lit("read by a key that is no literal").alias("reason"))


def reaching(files: DataFrame, owners: DataFrame) -> DataFrame:
    """Files that name an owner whole (owners: name), unreadable ones included."""
    return mention_files(files, owners.select("name"))


def qualified(wrappers: DataFrame, declared: DataFrame, subclassed: DataFrame, published: DataFrame) -> DataFrame:
    """Wrappers (path, name, owner) whose name is declared once (declared: path, name), whose owner has no subclass and that aren't published."""
    lone = unique(declared.select("path", "name").distinct(), ["name"]).select("name")
    return wrappers.join(lone, "name", "left_semi").join(subclassed.select("owner").distinct(), "owner", "left_anti").join(published.select("name").distinct(), "name", "left_anti")


def bound_calls(calls: DataFrame, types: DataFrame, wrappers: DataFrame) -> DataFrame:
    """Calls (path, receiver, name) with `proven`: the receiver's declared type (path, receiver, type; one only) is the wrapper's owner."""
    one = types.groupBy("path", "receiver").agg(F.when(F.min("type") == F.max("type"), F.min("type")).alias("type"))
    met = calls.join(wrappers.select("name", "owner").distinct(), "name").join(one, ["path", "receiver"], "left")
    return met.withColumn("proven", F.coalesce(F.col("type") == F.col("owner"), F.lit(False)))


def close_out(wrappers: DataFrame, remaining: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Wrappers that nothing references any more, and the others with the references left (remaining: path, name)."""
    left = remaining.groupBy("name").agg(F.array_sort(F.collect_set("path")).alias("paths"))
    return wrappers.join(left.select("name"), "name", "left_anti"), wrappers.join(left, "name")
