"""A removal followed through names: constants that hold the key, and functions and constants that became what was served.

Rounds are semi-naive. The first folds the files that name the key, and those whose reads name it by a constant. A function or
constant at a module's top that thereby stands for a literal is a new fact, and the next round folds the files whose names lead to
it, and them alone, on from their text so far; rounds end when no fact is new, so a chain of n wrappers takes n + 1. Tables are cut by checkpoint between
rounds. Names are met over the whole corpus by `symbols.resolved`.

In the end a declaration goes if every use of it was replaced, no other file exports it on, and every other mention of its
name is proven (`operators.resolve.resolve`); a flag any of whose files is refused loses all of its rewrites later.
"""

from __future__ import annotations

import ast
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scanner import Token, Unreadable, scan, text
from ..operators import resolve
from ..operators.relational import _cut, hashed, small
from ..sources import checkout
from ..sources.config import Accessor, Gate
from . import parameters, remove, symbols
from .fold import MARKUP, SCRIPTS, _arguments, _statement_end

_STATE = ["flag", "path", "before", "after", "reads", "reason", "findings", "left"]
_SITED = [*_STATE, "sites"]


def facts_of(open_candidates: DataFrame, table: DataFrame) -> DataFrame:
    """Constants that hold a candidate's key: flag, at, own, of, form and value."""
    keys = small(open_candidates.select(F.col("key").alias("flag"), F.col("code_key").alias("target")))
    return table.where("kind = 'declaration'").join(keys, "target").select("flag", F.col("path").alias("at"), F.col("name").alias("own"), F.col("member").alias("of"), F.lit("key").alias("form"), F.lit(None).cast("boolean").alias("value"))


def spread_facts(facts: DataFrame, table: DataFrame, uses: DataFrame) -> DataFrame:
    """facts, and the entries of objects into which an object with such entries is spread, however often; an entry that the object declares itself is its own."""
    spark = table.sparkSession
    if table.where("kind = 'spread'").isEmpty():
        return facts
    into = table.where("kind = 'spread'").select("path", F.col("name").alias("into"), F.col("other").alias("name"))
    led = uses.where("at IS NOT NULL AND of = '' AND member = ''").select("path", "name", "at", "own").distinct()
    into = _cut(spark, into.join(led, ["path", "name"]).select("at", "own", F.col("path").alias("to"), "into"))
    own = table.where("kind = 'declaration'").select(F.col("path").alias("to"), F.col("name").alias("into"), F.col("member").alias("of"))
    fresh = facts
    while not into.isEmpty():
        more = fresh.where("of != ''").join(into, ["at", "own"]).join(own, ["to", "into", "of"], "left_anti").select("flag", F.col("to").alias("at"), F.col("into").alias("own"), "of", "form", "value")
        fresh = _cut(spark, more.join(facts.select("flag", "at", "own", "of"), ["flag", "at", "own", "of"], "left_anti").distinct())
        if fresh.isEmpty():
            break
        facts = _cut(spark, facts.union(fresh))
    return facts


def known_by(facts: DataFrame, uses: DataFrame) -> DataFrame:
    """For each flag and file the names there that lead to a fact: flag, path, known."""
    led = uses.where("at is not null").withColumnRenamed("of", "led")
    met = led.join(facts, ["at", "own"])
    exact = (F.col("led") == F.col("of")) | ((F.col("of") != "") & F.startswith("led", F.concat("of", F.lit(".")))) | ((F.col("of") == "") & (F.col("led") != ""))
    met = met.where(exact)
    over = F.length("led") - F.length("of")  # what is used on the fact itself is no part of its name
    member = F.when(over == 0, F.col("member")).otherwise(F.expr("trim(TRAILING '.' FROM left(member, greatest(length(member) - length(led) + length(of), 0)))"))
    return met.groupBy("flag", "path").agg(F.collect_set(F.struct("name", member.alias("member"), "form", "value")).alias("known"))


def made_by(done: DataFrame) -> DataFrame:
    """The facts that folds made."""
    made = done.where("reason is null").select("flag", F.col("path").alias("at"), F.explode("made").alias("m"))
    return made.select("flag", "at", F.col("m.name").alias("own"), F.lit("").alias("of"), F.col("m.form").alias("form"), F.col("m.value").alias("value"))


def spread(open_candidates: DataFrame, pairs: DataFrame, files: DataFrame, table: DataFrame, accessors: Sequence[Accessor], gates: Sequence[Gate] = (), inert: Sequence[str] = ()) -> tuple[DataFrame, DataFrame, symbols.Resolved]:
    """The folds of all files that a flag reaches (flag, path, before, after, reads, reason, findings, left, sites), the facts met, and what names lead to.

    pairs: flag, code_key, treatment, path, language, before. table: `symbols.symbols` of the files.
    """
    spark = files.sparkSession
    names = symbols.resolved(table, files)
    fresh = facts = _cut(spark, facts_of(open_candidates, table))
    flags = small(open_candidates.select(F.col("key").alias("flag"), "code_key", "treatment"))
    sources = files.select("path", F.col("content").alias("source"))
    state = None
    if fresh.isEmpty():  # no name leads to a fact yet
        done = _cut(spark, remove.folded(pairs, accessors, gates, inert, sites=True).drop("gone"))
        state = done.select(_SITED)
        fresh = _cut(spark, made_by(done))
        if fresh.isEmpty():
            return state, facts, names
        facts = _cut(spark, facts.union(fresh))
    names = names._replace(uses=_cut(spark, names.uses))  # many rows, and no round has asked for them before
    uses = names.uses
    if state is None:
        fresh = facts = spread_facts(facts, table, uses)
    while True:
        named = known_by(fresh, uses)
        asked = pairs.select("flag", "path").union(named.select("flag", "path")).distinct() if state is None else named.select("flag", "path")
        work = asked.join(flags, "flag").join(named, ["flag", "path"], "left").join(sources, "path").where("source is not null")
        if state is not None:
            work = work.join(state.select("flag", "path", F.col("after").alias("so_far"), F.col("before").alias("first"), F.col("reads").alias("had"), F.col("reason").alias("why"), F.col("findings").alias("found"), F.col("left").alias("stay")), ["flag", "path"], "left").where("why is null")
        else:
            work = work.withColumns({"so_far": F.lit(None).cast("string"), "had": F.lit(0), "found": F.array().cast("array<struct<line:int,kind:string,reason:string>>"), "stay": F.lit(0)})
        work = work.select("flag", "code_key", "treatment", "path", checkout.language(F.col("path")).alias("language"), F.coalesce("so_far", "source").alias("before"), "source", "known", "had", "found", "stay")
        done = _cut(spark, remove.folded(work, accessors, gates, inert, keep=("source", "had", "found", "stay"), sites=True).drop("gone"))
        new = done.select("flag", "path", F.col("source").alias("before"), "after", (F.col("reads") + F.coalesce("had", F.lit(0))).alias("reads"), "reason", F.concat(F.coalesce("found", F.array().cast("array<struct<line:int,kind:string,reason:string>>")), "findings").alias("findings"), (F.col("left") + F.coalesce("stay", F.lit(0))).alias("left"), "sites")
        state = _cut(spark, new if state is None else state.join(new.select("flag", "path"), ["flag", "path"], "left_anti").select(_SITED).union(new.select(_SITED)))
        fresh = _cut(spark, made_by(done).join(facts.select("flag", "at", "own", "of"), ["flag", "at", "own", "of"], "left_anti"))
        if fresh.isEmpty():
            return state, facts, names
        facts = _cut(spark, facts.union(fresh))


def deletable(facts: DataFrame, names: symbols.Resolved, table: DataFrame, state: DataFrame, files: DataFrame) -> DataFrame:
    """Facts whose declarations can go: flag, path, owner, name."""
    spark = files.sparkSession
    owner, name = symbols.owner_and_name(F.col("own"), F.col("of"))
    # what a flag with a refusal reaches stays
    stuck = state.groupBy("flag").agg(F.bool_or(F.col("reason").isNotNull()).alias("stuck")).where("stuck").select("flag")
    free = _cut(spark, facts.join(stuck, "flag", "left_anti").select("flag", F.col("at").alias("path"), F.col("at").alias("module"), owner, name, "form", F.col("own"), F.col("of")))
    led = names.uses.where("at is not null").join(free.select("flag", F.col("module").alias("at"), "own", F.col("of").alias("_of"), "owner", F.col("name").alias("_name")), ["at", "own"])
    led = led.where("_of = '' OR of = '' OR of = _of OR startswith(of, _of || '.') OR startswith(_of, of || '.')")
    # a use is gone if its file was folded and has none left: replaced, or deleted with a branch around it
    folded = state.where("reason IS NULL AND left = 0").select("flag", "path", F.lit(True).alias("clean"))
    led = led.join(folded, ["flag", "path"], "left")
    references = led.select("path", F.col("at").alias("module"), "owner", F.col("_name").alias("name"), F.coalesce("clean", F.lit(False)).alias("removable"))
    language, judged = checkout.language(F.col("path")), None
    for family, others in ((["python"], SCRIPTS), (SCRIPTS, ["python"])):  # a script names nothing of a Python module
        mine = free.where(language.isin(*family)).select("path", "module", "owner", "name", F.col("flag").alias("key"))
        if not mine.isEmpty():
            found = resolve.resolve(mine, references, files.where(language.isNotNull() & ~language.isin(*others)).select("path", "content"))["deletable"]
            judged = found if judged is None else judged.union(found)
    if judged is None:
        return free.select("flag", "path", "owner", "name", "form")
    # scripts say what they export on; a Python module exports on what another takes from it by way of its own import
    taken = names.taken
    onward = table.where("kind = 'export' AND target IS NOT NULL AND NOT endswith(path, '.py')").select(F.explode(F.array("name", "other")).alias("own")).union(taken.where("module != at").select("own")).distinct()
    listed = table.where("kind = 'export' AND target IS NULL AND line IS NOT NULL").select("path", F.col("other").alias("own")).distinct()
    gone = free.join(judged.select("path", "owner", "name").distinct(), ["path", "owner", "name"], "left_semi").join(onward, "own", "left_anti").join(listed, ["path", "own"], "left_anti")
    return gone.select("flag", "path", "owner", "name", "form").distinct()


def without_declaration(source: str, language: str, owner: str, name: str) -> str:
    """A source without the declaration of a constant, a function or an entry at its top; the source itself where it isn't found."""
    if language == "python":
        tree, lines = ast.parse(source), source.splitlines(keepends=True)
        body = tree.body if not owner else next((s.body for s in tree.body if isinstance(s, ast.ClassDef) and s.name == owner), [])
        for s in body:
            target = s.targets[0] if isinstance(s, ast.Assign) and len(s.targets) == 1 else s.target if isinstance(s, ast.AnnAssign) else None
            if (isinstance(s, ast.FunctionDef) and s.name == name) or (isinstance(target, ast.Name) and target.id == name):
                if owner and len(body) == 1:
                    return source
                return "".join(lines[: s.lineno - 1] + lines[s.end_lineno :])
        return source
    tokens, tail = scan(source, language in MARKUP, language)
    match = symbols.matches(tokens)
    said = lambda k: tokens[k].text if 0 <= k < len(tokens) else ""
    owners = owner.split(".") if owner else []

    def entry(o: int, key: str) -> tuple[int, int] | None:
        """The stretch of an entry of the object that opens at o, without its comma."""
        at = o + 1
        while at < match[o]:
            end = at
            while end < match[o] and said(end) != ",":
                end = match.get(end, end) + 1
            if said(at) == key or said(at)[1:-1] == key:
                return at, end
            at = end + 1
        return None

    for k in symbols._top(tokens, match):
        if said(k) not in ("const", "function", "enum") or said(k + 1) != (owners or [name])[0]:
            continue
        if owners:
            o = next((x for x in range(k + 2, len(tokens)) if said(x) == "{"), None)
            for key in owners[1:]:
                found = entry(o, key) if o is not None else None
                o = found[0] + 2 if found and said(found[0] + 2) == "{" else None
            if o is None or (found := entry(o, name)) is None:
                return source
            del tokens[found[0] : found[1] + (said(found[1]) == ",")]
            return text(tokens, tail)
        start, end = k - (said(k - 1) == "export"), match[next(x for x in range(k, len(tokens)) if said(x) == "{")] + 1 if said(k) == "function" else None
        if end is None:
            end = next((x + 1 for x in _statement(tokens, match, k) if said(x) == ";"), None) or _statement_end(tokens, k)
        if start == 0 and end < len(tokens):
            tokens[end].gap = tokens[end].gap.lstrip("\n")
        del tokens[start:end]
        return text(tokens, tail if tokens else tail.lstrip("\n"))
    return source


def _statement(tokens, match, k: int):
    """Places at the top of the statement that starts at k, up to the line's end that ends it or its sign."""
    x = k
    while x < len(tokens) and not (x > k and "\n" in tokens[x].gap and tokens[x].kind == "id" and tokens[x - 1].text not in ("=", "=>", "(", ",")):
        yield x
        if tokens[x].text == ";":
            return
        x = match.get(x, x) + 1


def without_imports(source: str, language: str, names: list[str]) -> str:
    """A source that doesn't import these names any more; in scripts those that the module's scope still uses stay."""
    if language != "python":
        tokens, tail = scan(source, language in MARKUP, language)
        scopes = symbols.Scopes(tokens)
        idle = set(names) - {name for _, name, _ in symbols.references(tokens, scopes, set(names))}
        for k in reversed([k for k in symbols._top(tokens, scopes.match) if tokens[k].text == "import"]):
            if scopes.text(k + 1) != "{":
                continue
            c = scopes.match[k + 1]
            items = [x for x in _arguments(tokens, k + 1, c) if tokens[x[1] - 1].text not in idle]
            if len(items) == len(_arguments(tokens, k + 1, c)):
                continue
            if items:
                kept = [tokens[a:b] for a, b in items]
                tokens[k + 2 : c] = [t for n, part in enumerate(kept) for t in ([Token("sign", ",")] if n else []) + part]
            else:
                end = next((x + 1 for x in range(c, len(tokens)) if tokens[x].text == ";" or tokens[x].kind == "str" and scopes.text(x + 1) != ";"), c + 1)
                del tokens[k:end]
                if not k and tokens:
                    tokens[0].gap = tokens[0].gap.lstrip("\n")
        return text(tokens, tail if tokens else tail.lstrip("\n"))
    lines = source.splitlines(keepends=True)
    for s in reversed(ast.parse(source).body):
        if isinstance(s, ast.ImportFrom) and any((a.asname or a.name) in names for a in s.names):
            s.names = [a for a in s.names if (a.asname or a.name) not in names]
            lines[s.lineno - 1 : s.end_lineno] = [ast.unparse(s) + "\n"] if s.names else []
    return "".join(lines)


def cleared(state: DataFrame, gone: DataFrame, files: DataFrame, met: symbols.Resolved) -> DataFrame:
    """The folds with the declarations that can go taken out of their files, and the imports of them; a file that only declares joins them."""
    entry = F.struct("owner", "name", F.lit(False).alias("imported"))
    lone = gone.where("owner = ''").select("flag", F.col("path").alias("at"), F.col("name").alias("own"))
    taken = met.taken.join(lone, ["at", "own"]).select("flag", "path", F.struct(F.lit("").alias("owner"), "name", F.lit(True).alias("imported")).alias("entry"))
    names = gone.select("flag", "path", entry.alias("entry")).union(taken).groupBy("flag", "path").agg(F.array_sort(F.collect_set("entry")).alias("names"))
    sources = files.select("path", F.col("content").alias("source"))
    work = names.join(state, ["flag", "path"], "left").join(sources, "path").select("flag", "path", F.coalesce("after", "source").alias("now"), F.coalesce("before", "source").alias("before"), "names", checkout.language(F.col("path")).alias("language"), F.coalesce("reads", F.lit(0)).alias("reads"), "reason", "findings", F.coalesce("left", F.lit(0)).alias("left"))

    @F.pandas_udf("string")
    def taken(now, language, every):
        out = []
        for source, kind, names in zip(now, language, every, strict=True):
            try:
                gone = [x["name"] for x in names if x["imported"]]
                source = without_imports(source, kind, gone) if gone else source
                for x in names:
                    source = source if x["imported"] else without_declaration(source, kind, x["owner"], x["name"])
            except (Unreadable, SyntaxError, StopIteration, IndexError, ValueError):
                pass
            out.append(source)
        return pd.Series(out, dtype=object)

    done = work.withColumn("after", taken("now", "language", "names"))
    done = done.withColumn("reads", F.greatest("reads", F.when(F.col("after") != F.col("now"), 1).otherwise(0))).withColumn("findings", F.coalesce("findings", F.array().cast("array<struct<line:int,kind:string,reason:string>>")))
    return state.join(names.select("flag", "path"), ["flag", "path"], "left_anti").select(_STATE).union(done.select(_STATE))


def followed(open_candidates: DataFrame, pairs: DataFrame, files: DataFrame, table: DataFrame, accessors: Sequence[Accessor], gates: Sequence[Gate] = (), inert: Sequence[str] = (), held: DataFrame | None = None) -> DataFrame:
    """The folds of all files that candidates (key, code_key, treatment) reach, without the parameters they made constant and the declarations that nothing needs any more. held: `parameters.read` of the files, where the symbols in table come from it."""
    with hashed(files.sparkSession):
        folds, facts, names = spread(open_candidates, pairs, files, table, accessors, gates, inert)
        folds = parameters.inlined(folds, files, names, held)
        if facts.isEmpty():  # no declaration holds a key or became what was served
            return folds
        gone = _cut(files.sparkSession, deletable(facts, names, table, folds, files))
        return folds if gone.isEmpty() else _cut(files.sparkSession, cleared(folds, gone, files, names))


#: Languages whose names are followed.
FOLLOWED = (*SCRIPTS, "python")
