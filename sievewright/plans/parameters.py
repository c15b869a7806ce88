"""Parameters that a removal made constant: taken out of a function and of every call of it, as one unit.

A call graph with argument places is read from the texts after a fold, and from those before it. A parameter goes if every call in the
corpus gives it the same literal true or false now and did not before, the function is only ever called, and both
sides can be rewritten; if one side can't, neither is. Functions at a module's top in scripts, by position, and components whose properties are
destructured, by name.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scanner import Token, Tokens, Unreadable, scan, text
from ..operators.relational import _cut, dealt
from ..sources import checkout
from ..sources.config import Accessor
from . import symbols
from .alike import rows_alike
from .fold import MARKUP, SCRIPTS, Refused, _arguments, _literal, _simplify, refusal

SITES = "flag string, path string, kind string, name string, member string, position int, label string, value string"


class Declared(NamedTuple):
    """A function at the top of a module: the brackets of its parameters, and what each binds (a name, or the names of its properties)."""

    name: str
    open: int
    params: list[tuple[int, int, str, dict[str, int]]]


def functions(tokens: Tokens, scopes: symbols.Scopes) -> list[Declared]:
    """Functions whose parameters are names or, the only one, a pattern of properties; others have no parameters here."""
    out = []
    for k in symbols._top(tokens, scopes.match):
        name = o = None
        if scopes.text(k) == "function" and scopes.text(k + 2) == "(":
            name, o = scopes.text(k + 1), k + 2
        elif scopes.text(k) == "const" and scopes.text(k + 2) in ("=", ":"):
            at = k + 2
            while at < len(tokens) and scopes.text(at) not in ("=", ";"):
                at = scopes.match.get(at, at) + 1
            at += 1 + (scopes.text(at + 1) == "async")
            if scopes.text(at) == "(" and at in scopes.match and scopes.text(scopes.match[at] + 1) in ("=>", ":"):
                name, o = scopes.text(k + 1), at
        if name is None:
            continue
        params = []
        for a, b in _arguments(tokens, o, scopes.match[o]):
            if tokens[a].kind == "id" and scopes.text(a + 1) in (",", ")", ":", "?") and not any(tokens[x].text == "=" for x in range(a, b)):
                params.append((a, b, tokens[a].text, {}))
            elif scopes.text(a) == "{":
                held = {tokens[x].text: x for x, y in _arguments(tokens, a, scopes.match[a]) if y - x == 1 and tokens[x].kind == "id"}
                params.append((a, b, "", held))
            else:
                params.append((a, b, "", {}))
        out.append(Declared(name, o, params))
    return out


def sites(source: str, language: str) -> list[tuple[str, str, str, int | None, str | None, str | None]]:
    """(kind, name, member, position, label, value): parameters of functions, arguments of calls, properties of elements, and uses of another kind."""
    tokens, _ = scan(source, language in MARKUP, language)
    scopes, out = symbols.Scopes(tokens), []
    for f in functions(tokens, scopes):
        for n, (_, _, name, held) in enumerate(f.params):
            out += [("parameter", f.name, "", n, None, name)] if name else [("property", f.name, "", None, x, x) for x in held] if n == 0 else []
    literal = lambda a, b: tokens[a].text if b - a == 1 and tokens[a].kind in ("id", "num", "str") else None
    for k, name, members in symbols.references(tokens, scopes):
        end, member = k + 1 + 2 * len(members), ".".join(members)
        if tokens[k - 1].kind == "tag" and k and tokens[k - 1].text == "<" and not members:
            x, given, spread = end, [], False
            while x < len(tokens) and not (tokens[x].kind == "tag" and tokens[x].text in (">", "/>")):
                if x in scopes.match:
                    spread |= scopes.text(x + 1) == "..."
                    x = scopes.match[x]
                elif tokens[x].kind == "id":
                    plain = not (tokens[x + 1].kind == "tag" and tokens[x + 1].text == "=")
                    o = x + 2
                    given.append((tokens[x].text, "true" if plain else literal(o + 1, scopes.match[o]) if o in scopes.match else None if tokens[o].kind == "id" else tokens[o].text))
                    x = x if plain else scopes.match.get(o, o)
                x += 1
            out += [("other", name, "", None, None, None)] if spread else [("element", name, "", None, None, None), *(("given", name, "", None, p, v) for p, v in given)]
        elif scopes.text(end) == "(" and scopes.text(k - 1) != "new":
            arguments = _arguments(tokens, end, scopes.match[end])
            if any(scopes.text(a) == "..." for a, _ in arguments):
                out.append(("other", name, member, None, None, None))
            else:
                out += [("call", name, member, len(arguments), None, None), *(("given", name, member, n, None, literal(a, b)) for n, (a, b) in enumerate(arguments))]
        else:
            out.append(("other", name, member, None, None, None))
    return out


def tally(source: str, language: str) -> list[tuple[bool, str, str, int, int, int, list[tuple[int | None, str | None, int, str | None]]]]:
    """The sites of a source, summed: (function, name, member, calls, elements, others, places) of each name. places: position, label, how often it is given, and the one value that all calls here give it.

    function: a function of the source's own, whose places are its parameters. One that can't be read has no sites, as a fold of it is refused anyway.
    """
    try:
        found = sites(source, language)
    except (Unreadable, IndexError, KeyError, RecursionError):
        return []
    functions, uses = {}, {}
    for kind, name, member, position, label, value in found:
        if kind in ("parameter", "property"):
            functions.setdefault(name, []).append((None if kind == "property" else position, label, 0, None))
            continue
        counts, places = uses.setdefault((name, member), ({"call": 0, "element": 0, "other": 0}, {}))
        if kind == "given":
            n, agreed = places.get((position, label), (0, value))
            places[position, label] = n + 1, agreed if agreed == value else None
        else:
            counts[kind] += 1
    out = [(True, name, "", 0, 0, 0, places) for name, places in functions.items()]
    return out + [(False, *names, *counts.values(), [(*place, *told) for place, told in places.items()]) for names, (counts, places) in uses.items()]


_SYMBOL = "array<struct<kind:string,name:string,member:string,target:string,other:string,removable:boolean,line:int>>"
TALLY = "array<struct<function:boolean,name:string,member:string,calls:int,elements:int,others:int,places:array<struct<position:int,label:string,n:int,value:string>>>>"


def read(files: DataFrame, accessors: Sequence[Accessor]) -> DataFrame:
    """The symbols and the sites of files (path, language, content), a row for each file: path, symbols, sites. A file is read once for both."""
    reads = list(accessors)

    def script(source: str, language: str) -> tuple[list, list]:
        return symbols.read_one(source, language, reads), tally(source, language)

    def run(batches):
        alike = rows_alike(script, MARKUP, map(repr, reads))
        for batch in batches:
            both = []
            for language, source in zip(*(symbols.values(batch.column(c)) for c in ("language", "content")), strict=True):
                both.append(alike(language, (), source) if language in SCRIPTS and source is not None else (symbols.read_one(source, language, reads), []))
            found, held = zip(*both, strict=True) if both else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column("path"), symbols.column(found, symbols.ARROW), symbols.column(held, ARROW)], names=["path", "symbols", "sites"])

    return dealt(files.select("path", "language", "content"), "path").mapInArrow(run, f"path string, symbols {_SYMBOL}, sites {TALLY}")


_PLACES = pa.list_(pa.struct({"position": pa.int32(), "label": pa.string(), "n": pa.int32(), "value": pa.string()}))
ARROW = pa.list_(pa.struct({"function": pa.bool_(), "name": pa.string(), "member": pa.string(), "calls": pa.int32(), "elements": pa.int32(), "others": pa.int32(), "places": _PLACES}))


def read_sites(texts: DataFrame) -> DataFrame:
    """The sites of texts (flag, path, content), a row each; one that can't be read has none."""

    def run(batches):
        read = rows_alike(sites, MARKUP)
        for batch in batches:
            rows = []
            for flag, path, language, source in zip(*(batch.column(c).to_pylist() for c in ("flag", "path", "language", "content")), strict=True):
                try:
                    rows += [(flag, path, *x) for x in read(language, (), source)]
                except (Unreadable, IndexError, KeyError, RecursionError):
                    continue
            kinds = [pa.string()] * 5 + [pa.int32(), pa.string(), pa.string()]
            names = [x.split(" ")[0] for x in SITES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

    language = checkout.language(F.col("path"))
    asked = texts.select("flag", "path", language.alias("language"), "content").where(F.col("content").isNotNull() & language.isin(*SCRIPTS))
    return dealt(asked, "flag", "path").mapInArrow(run, SITES)


def _rewritten(source: str, *told: object) -> str:
    """`rewritten` by three words of each drop (name, member, label), the language and the rest of each (position, whether by label, value, declared)."""
    *words, language, rest = told
    drops = [{"name": words[3 * n], "member": words[3 * n + 1], "label": words[3 * n + 2] if labelled else None, "position": position, "value": value, "declared": declared} for n, (position, labelled, value, declared) in enumerate(rest)]
    return rewritten(source, language, drops)


def rewritten(source: str, language: str, drops: list[dict]) -> str:
    """A source without parameters (declared: they are the file's own functions') and arguments. Raises Refused if one side of it can't be."""
    tokens, tail = scan(source, language in MARKUP, language)
    tokens.language = language
    scopes = symbols.Scopes(tokens)
    cuts: list[tuple[int, int]] = []
    puts: list[tuple[int, bool, bool]] = []

    def without(a: int, b: int, first: int, end: int) -> tuple[int, int]:
        """An item with the comma after it, or before it if it is the last."""
        return (a, b + 1) if b < end and scopes.text(b) == "," else (a - 1, b) if a > first else (a, b)

    for d in drops:
        value = d["value"] == "true"
        if d["declared"]:
            f = next((x for x in functions(tokens, scopes) if x.name == d["name"]), None)
            if f is None:
                raise Refused(f"{d['name']} is not found")
            if d["label"] is None:
                a, b, bound, _ = f.params[d["position"]]
                cuts.append(without(a, b, f.open + 1, scopes.match[f.open]))
            else:
                a, bound = f.params[0][3][d["label"]], d["label"]
                o = f.params[0][0]
                cuts.append(without(a, a + 1, o + 1, scopes.match[o]))
                kinds = next((x for x in range(scopes.match[o] + 1, f.params[0][1]) if scopes.text(x) == "{"), None)
                if scopes.match[o] + 1 < f.params[0][1] and kinds is None:
                    raise Refused("the type of the properties is declared elsewhere")
                if kinds is not None:
                    at = kinds + 1
                    while at < scopes.match[kinds]:
                        stop = at
                        while stop < scopes.match[kinds] and scopes.text(stop) not in (",", ";"):
                            stop = scopes.match.get(stop, stop) + 1
                        if scopes.text(at) == bound:
                            cuts.append((at, stop + (stop < scopes.match[kinds])))
                        at = stop + 1
            span = next((s for s in scopes.spans if s[0] == f.open), None)
            if span is None or bound not in span[2]:
                raise Refused(f"the scope of {bound} is not known")
            for k in range(scopes.match[f.open] + 1, span[1] + 1):
                if k >= len(tokens) or tokens[k].kind not in ("id", "tpl") or (tokens[k].kind == "id" and tokens[k].text != bound):
                    continue
                if tokens[k].kind == "tpl":
                    if bound in tokens[k].text:
                        raise Refused(f"{bound} is used within a string")
                    continue
                if scopes.text(k - 1) in (".", "?.") or (scopes.text(k + 1) == ":" and scopes.text(k - 1) in ("{", ",") and scopes._around(k) == "{"):
                    continue
                inner = max((s for s in scopes.spans if s[0] < k <= s[1] and bound in s[2]), key=lambda s: (s[0], -s[1]))
                if inner is not span:
                    continue
                use = symbols.used_as(tokens, scopes, k, k + 1)
                short = scopes.shorthand(k)
                if use != "plain" and not short:
                    raise Refused(f"{bound} is changed, called or bound anew")
                puts.append((k, value, short))
            continue
        for k, name, members in symbols.references(tokens, scopes, {d["name"]}):
            if ".".join(members) != d["member"]:
                continue
            end = k + 1 + 2 * len(members)
            if d["label"] is None and scopes.text(end) == "(":
                a, b = _arguments(tokens, end, scopes.match[end])[d["position"]]
                cuts.append(without(a, b, end + 1, scopes.match[end]))
            elif d["label"] is not None and k and tokens[k - 1].text == "<":
                x = end
                while x < len(tokens) and not (tokens[x].kind == "tag" and tokens[x].text in (">", "/>")):
                    if tokens[x].kind == "id" and tokens[x].text == d["label"]:
                        plain = not (tokens[x + 1].kind == "tag" and tokens[x + 1].text == "=")
                        cuts.append((x, x + 1 if plain else scopes.match.get(x + 2, x + 2) + 1))
                        break
                    x = scopes.match.get(x, x) + 1
    if len({a for a, _ in cuts}) < len(cuts):
        raise Refused("two items share a comma")
    for k, value, short in puts:
        new = _literal(value, tokens[k].gap)
        tokens[k] = Token("raw", f"{tokens[k].text}: {new.text}", tokens[k].gap) if short else new
    gone = {id(tokens[x]) for a, b in cuts for x in range(a, b)}
    for a, b in cuts:
        if b < len(tokens) and id(tokens[b]) not in gone and tokens[a].gap != tokens[b].gap and scopes.text(b) not in (")", "]", "}", ","):
            tokens[b].gap = tokens[a].gap
    tokens[:] = [t for t in tokens if id(t) not in gone]
    _simplify(tokens, "\0")
    after = text(tokens, tail)
    if (why := refusal(source, after, language)) is not None:
        raise Refused(why)
    return after


def inlined(state: DataFrame, files: DataFrame, names: symbols.Resolved, held: DataFrame | None = None) -> DataFrame:
    """The folds (as `spread.spread` gives them, with the sites of what was rewritten) without the parameters that they made constant, on both sides. held: path and sites of the files, where they are read already (`read`)."""
    spark = files.sparkSession
    plain = state.drop("sites")
    changed = state.where("reason IS NULL AND after != before")
    if changed.isEmpty():
        return plain
    if held is None:
        held = _cut(spark, read(files.withColumn("language", checkout.language(F.col("path"))), []))
    held = held.select("path", F.inline("sites"))
    site = ["path", "name", "member", "calls", "elements", "others", "places"]
    sited = held.where("NOT function").select(F.lit(None).cast("string").alias("flag"), *site).union(changed.select("flag", "path", F.inline("sites")).where("NOT function").select("flag", *site))
    placed = _cut(spark, symbols.led_by(sited, names.imports, names.ends).where("at IS NOT NULL AND of = ''").drop("of"))  # sites with the function that they are of
    now, old = placed.where("flag IS NOT NULL"), placed.where("flag IS NULL").drop("flag")
    touched = _cut(spark, now.where(F.exists("places", lambda p: p["value"].isin("true", "false"))).select("flag", "at", "own").distinct())
    if touched.isEmpty():
        return plain
    # for a flag the sites of these functions as they were, and whether the flag rewrote their file
    hot = old.join(touched, ["at", "own"]).join(changed.select("flag", "path", F.lit(True).alias("stale")), ["flag", "path"], "left")
    every = _cut(spark, hot).withColumn("was", F.lit(True)).unionByName(now.withColumns({"stale": F.lit(None).cast("boolean"), "was": F.lit(False)}))
    is_now = F.col("stale").isNull()
    said = F.when(F.col("p.value").isin("true", "false"), F.col("p.value") == "true")  # as strings would be sorted to find the smallest
    given = every.select("flag", "at", "own", "stale", "was", F.explode("places").alias("p")).select("flag", "at", "own", "p.position", "p.label", "p.n", said.alias("value"), is_now.alias("is_now"), "was")

    def agreed(among: Column) -> Column:
        """The literal that all of these rows give, else null."""
        value = F.when(among, F.col("value"))
        return F.when((F.min(value) == F.max(value)) & (F.count(value) == F.count_if(among)), F.min(value))

    place = ["at", "own", "position", "label"]
    drops = given.groupBy("flag", *place).agg(agreed(F.col("is_now")).alias("value"), agreed(F.col("was")).alias("before"), F.sum(F.when(F.col("is_now"), F.col("n"))).alias("n")).where("value IS NOT NULL AND before IS NULL")
    calls = every.where(is_now).groupBy("flag", "at", "own").agg(*(F.sum(c).alias(c) for c in ("calls", "elements", "others"))).where("others = 0")
    drops = drops.join(calls, ["flag", "at", "own"]).where((F.col("position").isNotNull() & (F.col("n") == F.col("calls")) & (F.col("elements") == 0)) | (F.col("label").isNotNull() & (F.col("n") == F.col("elements")) & (F.col("calls") == 0)))
    params = held.where("function").select(F.col("path").alias("at"), F.col("name").alias("own"), F.explode("places").alias("p")).select("at", "own", "p.position", "p.label").distinct()
    drops = drops.join(params, (drops["at"] == params["at"]) & (drops["own"] == params["own"]) & drops["position"].eqNullSafe(params["position"]) & drops["label"].eqNullSafe(params["label"]), "left_semi")
    drops = drops.withColumn("value", F.col("value").cast("string")).groupBy("flag", "at", "own").agg(F.max(F.struct(F.coalesce("position", F.lit(-1)).alias("p"), "position", "label", "value")).alias("d")).select("flag", "at", "own", "d.position", "d.label", "d.value")  # one of a function at a time
    drops = _cut(spark, drops)
    texts = state.where("reason IS NULL").select("flag", "path", F.col("after").alias("now"))
    for attempt in (0, 1):
        if drops.isEmpty():
            return plain
        callers = drops.join(every.where(is_now & (F.col("calls") + F.col("elements") > 0)).select("flag", "at", "own", "path", "name", "member"), ["flag", "at", "own"])
        entry = lambda name, member, declared: F.struct("at", "own", name.alias("name"), member.alias("member"), "position", "label", "value", F.lit(declared).alias("declared"))
        both = callers.select("flag", "path", entry(F.col("name"), F.col("member"), False).alias("d")).union(drops.select("flag", F.col("at").alias("path"), entry(F.col("own"), F.lit(""), True).alias("d")))
        work = both.groupBy("flag", "path").agg(F.collect_set("d").alias("drops")).join(texts, ["flag", "path"], "left").join(files.select("path", F.col("content").alias("source")), "path")
        work = work.select("flag", "path", checkout.language(F.col("path")).alias("language"), F.coalesce("now", "source").alias("now"), "source", "drops")

        def run(batches):
            rewrite = rows_alike(_rewritten, MARKUP)
            for batch in batches:
                after = []
                for source, language, drops in zip(*(symbols.values(batch.column(c)) for c in ("now", "language")), batch.column("drops").to_pylist(), strict=True):
                    drops.sort(key=lambda d: (not d["declared"], d["name"], d["member"], d["label"] or ""))
                    words = [x for d in drops for x in (d["name"], d["member"], d["label"] or "")]
                    rest = tuple((d["position"], d["label"] is not None, d["value"], d["declared"]) for d in drops)
                    try:
                        after.append(rewrite(language, (rest,), source, *words))
                    except (Refused, Unreadable, IndexError, KeyError, StopIteration, RecursionError):
                        after.append(None)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("flag", "path", "source", "drops")), pa.array(after, pa.string())], names=["flag", "path", "source", "drops", "after"])

        done = _cut(spark, dealt(work, "flag", "path").mapInArrow(run, work.select("flag", "path", "source", "drops", F.lit(None).cast("string").alias("after")).schema))
        lost = done.where("after IS NULL").select("flag", F.explode("drops").alias("d")).select("flag", "d.at", "d.own").distinct()
        if lost.isEmpty():
            break
        drops = _cut(spark, drops.join(lost, ["flag", "at", "own"], "left_anti"))  # neither side of these
    else:
        return plain
    new = done.select("flag", "path", F.col("source").alias("_source"), F.col("after").alias("_after"))
    joined = plain.join(new, ["flag", "path"], "full")
    return _cut(spark, joined.select("flag", "path", F.coalesce("before", "_source").alias("before"), F.coalesce("_after", "after").alias("after"), F.greatest(F.coalesce("reads", F.lit(0)), F.when(F.col("_after").isNotNull(), 1).otherwise(0)).alias("reads"), "reason", F.coalesce("findings", F.array().cast("array<struct<line:int,kind:string,reason:string>>")).alias("findings"), F.coalesce("left", F.lit(0)).alias("left")))
