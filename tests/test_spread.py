"""Symbols of sources, what names lead to, and removals followed through them."""

import pytest
from sievewright.functions.scanner import scan
from sievewright.operators import resolve
from sievewright.plans import remove, spread, symbols
from sievewright.plans.fold import Known, fold
from sievewright.plans import python_fold
from sievewright.sources.config import accessors

READS = accessors("isEnabled")[0]

FILES = {
    "src/flags.ts": "export const KEY = 'k';\nexport const FLAGS = { A: 'k', 'B': 'other', C: f(1, 2), D: 'd' } as const;\nexport enum E { X = 'k', Y = 'y' }\nconst hidden = 'k';\nexport default KEY;\n",
    "src/index.ts": "export { KEY as NEW, FLAGS } from './flags';\nexport * from './more';\n",
    "src/more.ts": "import { E } from './flags.js';\nexport { E };\nexport const own = 1;\n",
    "src/app/a.tsx": "import { NEW, FLAGS as F, E } from '..';\nimport * as all from '../index';\nimport dflt from '../flags';\nexport function go() { if (isEnabled(NEW)) { return <p>{isEnabled(F.A) ? 1 : 2}</p>; } isEnabled(all.FLAGS.B); isEnabled(dflt); isEnabled(E.X); }\n",
    "src/app/b.ts": "import { KEY } from '../flags';\nfunction f(KEY) { return isEnabled(KEY); }\nconst g = KEY => isEnabled(KEY);\nconst h = (x) => { const KEY = 1; return isEnabled(KEY); };\nisEnabled(KEY);\nlog({ KEY: 1, a: KEY.length });\n",
    "p/flags.py": "KEY = 'k'\nclass Flags:\n    A = 'k'\n",
    "p/__init__.py": "from .flags import KEY as NEW, Flags\n",
    "p/q/use.py": "from p import NEW\nimport p as m\nfrom ..flags import *\nfrom p.flags import Flags as G\ndef f(NEW=1):\n    return isEnabled(NEW)\ndef g():\n    return [isEnabled(NEW) for x in y] + isEnabled(m.Flags.A) + isEnabled(G.A) + len(G.A)\n",
    "bad.ts": "f(",
    "loop/a.ts": "export { x } from './b';\n", "loop/b.ts": "export { x } from './a';\n", "loop/use.ts": "import { x } from './a';\nisEnabled(x);\n",
}


def test_uses_lead_to_declarations(spark):
    kind = lambda p: {"py": "python"}.get(p.rsplit(".", 1)[1], p.rsplit(".", 1)[1])
    files = spark.createDataFrame([(p, kind(p), c) for p, c in FILES.items()] + [("null.ts", "ts", None)], "path string, language string, content string")
    table = symbols.symbols(files, READS).cache()
    tables = symbols.key_tables(table, files)
    got = sorted((r.path, r.module, f"{r.owner}.{r.name}", r.removable, r.root) for r in tables["references"].collect())
    assert got == sorted([
        ("src/app/a.tsx", "src/flags.ts", ".KEY", True, "NEW"), ("src/app/a.tsx", "src/flags.ts", "FLAGS.A", True, "F"), ("src/app/a.tsx", "src/flags.ts", "FLAGS.B", True, "all"), ("src/app/a.tsx", "src/flags.ts", ".KEY", True, "dflt"),
        ("src/app/a.tsx", "src/flags.ts", "E.X", True, "E"), ("src/app/b.ts", "src/flags.ts", ".KEY", True, "KEY"), ("src/app/b.ts", "src/flags.ts", ".KEY", False, "KEY"), ("src/flags.ts", "src/flags.ts", ".KEY", False, "KEY"),
        ("p/q/use.py", "p/flags.py", ".KEY", True, "NEW"), ("p/q/use.py", "p/flags.py", "Flags.A", True, "m"), ("p/q/use.py", "p/flags.py", "Flags.A", True, "G"), ("p/q/use.py", "p/flags.py", "Flags.A", False, "G"),
    ])
    declared = {(r.path, r.owner, r.name, r.key) for r in tables["declarations"].collect()}
    assert ("src/flags.ts", "FLAGS", "B", "other") in declared and ("src/flags.ts", "E", "Y", "y") in declared and ("p/flags.py", "Flags", "A", "k") in declared and ("src/flags.ts", "", "hidden", "k") in declared and len(declared) == 9
    assert sorted(r.path for r in table.where("kind = 'unreadable'").collect()) == ["bad.ts", "null.ts"]
    out = resolve.resolve(tables["declarations"], tables["references"], files.where("content is not null"))
    assert {r.name for r in out["blocked"].where("path = 'src/flags.ts'").collect()} >= {"KEY"}
    table.unpersist()


@pytest.mark.parametrize(
    ("source", "places"),
    [
        ("import { a } from 'x'; f(a);", 1), ("import { a } from 'x'; function g(a) { f(a); }", 0), ("import { a } from 'x'; { const a = 1; f(a); } f(a);", 1), ("import { a } from 'x'; for (const a of b) { f(a); }", 0), ("import { a } from 'x'; try { f(a); } catch (a) { f(a); }", 1),
        ("import { a } from 'x'; const { b: a2, c: { d = a } } = e;", 1), ("import { a } from 'x'; const g = ({ a }) => f(a);", 0), ("import { a } from 'x'; x.a = { a: a };", 1), ("import { a } from 'x'; const h = a => a; f(a);", 1), ("import { a } from 'x'; class C { m(a) { return a; } n() { return a; } }", 1),
        ("const a = 1; export { a };", 0), ("function a() {} a();", 1), ("import a, { b } from 'x'; f(b, a);", 1), ("import { a } from 'x'; const g = async (q: T, a?: U): Promise<V> => { f(a); }; f(a)", 1),
    ],
)
def test_scopes(source, places):
    tokens, _ = scan(source)
    assert len(list(symbols.references(tokens, symbols.Scopes(tokens), {"a"}))) == places


@pytest.mark.parametrize(
    ("source", "known", "after", "left", "made"),
    [
        ("import { K } from 'x';\nexport const f = () => isEnabled(K);\n", [Known("K", "", "key")], "export const f = () => true;\n", 0, [("f", "call", True)]),
        ("import { K } from 'x';\nlog(client?.isEnabled(K), isEnabled(K));\n", [Known("K", "", "key")], "import { K } from 'x';\nlog(client?.isEnabled(K), true);\n", 1, []),
        ("import { on } from 'x';\nif (on()) { a(); }\nsend(on);\n", [Known("on", "", "call", True)], "import { on } from 'x';\na();\nsend(on);\n", 1, []),
        ("import { ON } from 'x';\nconst f = (ON) => ON;\nexport const g = !ON && q;\nlog({ ON });\n", [Known("ON", "", "value", False)], "import { ON } from 'x';\nconst f = (ON) => ON;\nexport const g = q;\nlog({ ON });\n", 1, []),
        ("import { F } from 'x';\nexport function f(): boolean { return !isEnabled(F.A); }\nlog(F.B);\n", [Known("F", "A", "key")], "import { F } from 'x';\nexport function f(): boolean { return false; }\nlog(F.B);\n", 0, [("f", "call", False)]),
        ("import { on } from 'x';\nexport const f = async () => await on();\n", [Known("on", "", "call", True)], "export const f = async () => true;\n", 0, []),
    ],
)
def test_known_names(source, known, after, left, made):
    got = fold(source, "k", True, READS, "ts", known)
    assert (got.after, got.left, got.made) == (after, left, made)


def test_known_names_in_python():
    got = python_fold.fold("from x import K, on\ndef f():\n    return isEnabled(K)\ndef g(on):\n    return on()\nif on():\n    a(on)\n", "k", True, READS, [Known("K", "", "key"), Known("on", "", "call", False)])
    assert got.after == "from x import K, on\ndef f():\n    return True\ndef g(on):\n    return on()\n" and got.made == [("f", "call", True)] and got.left == 0
    got = python_fold.fold("import x as m\ny = m.ON or z\nsend(m.ON.real)\n", "k", True, READS, [Known("m", "ON", "value", True)])
    assert got.after == "import x as m\ny = True\nsend(m.ON.real)\n" and got.left == 1


@pytest.mark.parametrize(
    ("language", "source", "owner", "name", "after"),
    [
        ("ts", "export const A = 'k';\nexport const B = 1;\n", "", "A", "export const B = 1;\n"), ("ts", "const A = 'k'\nf()\n", "", "A", "f()\n"), ("ts", "a();\nexport function f() { return true; }\nb();\n", "", "f", "a();\nb();\n"), ("ts", "export const f = () => { return true; };\n", "", "f", ""),
        ("ts", "export const F = { A: 'x', B: 'k' };\n", "F", "B", "export const F = { A: 'x', };\n"), ("ts", "enum E {\n  A = 'k',\n  B = 'b',\n}\n", "E", "A", "enum E {\n  B = 'b',\n}\n"), ("ts", "const F = { 'B': 'k' };\n", "F", "B", "const F = { };\n"), ("ts", "const A = 1;\n", "", "Z", "const A = 1;\n"),
        ("python", "A = 'k'\nB = 1\n", "", "A", "B = 1\n"), ("python", "def f():\n    return True\n\nx = 1\n", "", "f", "\nx = 1\n"), ("python", "class F:\n    A = 'k'\n    B = 'b'\n", "F", "A", "class F:\n    B = 'b'\n"), ("python", "class F:\n    A = 'k'\n", "F", "A", "class F:\n    A = 'k'\n"),
    ],
)
def test_declarations_go(language, source, owner, name, after):
    assert spread.without_declaration(source, language, owner, name) == after


def test_imports_go():
    assert spread.without_imports("import { a, b as c } from 'x';\nimport { a as d } from 'y';\nf(d);\n", "ts", ["a", "d"]) == "import { b as c } from 'x';\nimport { a as d } from 'y';\nf(d);\n"
    assert spread.without_imports("from x import (a,\n  b)\nfrom y import a\n", "python", ["a"]) == "from x import b\n"


CHAIN = {
    "src/flags.ts": "export const KEY = 'k';\nexport const FLAGS = {\n  A: 'other',\n  B: 'k',\n} as const;\n",
    "src/one.ts": "import { KEY } from './flags';\nexport function isOn() {\n  return isEnabled(KEY);\n}\n",
    "src/two.ts": "import { isOn } from './one';\nexport const alsoOn = () => isOn();\n",
    "src/three.ts": "import { alsoOn } from './two';\nexport const ON: boolean = !alsoOn();\n",
    "src/four.ts": "import { ON } from './three';\nexport function shown(): boolean { return !ON; }\n",
    "src/five.tsx": "import { shown } from './four';\nimport { FLAGS } from './flags';\nexport const P = () => shown() ? <p>{isEnabled(FLAGS.B) ? 1 : 2}</p> : null;\n",
    "src/six.ts": "import { isOn } from './one';\nfunction f(isOn) { return isOn(); }\nlog(isOn() && f(g));\n",
    "p/flags.py": "PKEY = 'k'\nOTHER = 'o'\n", "p/one.py": "from p.flags import PKEY, OTHER\ndef is_on():\n    return isEnabled(PKEY)\n", "p/two.py": "from .one import is_on\nif is_on():\n    a()\nelse:\n    b()\n",
    # m: exported on, and used in another way
    "m/flags.ts": "export const MKEY = 'm';\nexport const used = () => isEnabled(MKEY);\n", "m/index.ts": "export { MKEY } from './flags';\n", "m/use.ts": "import { used } from './flags';\nsend(used);\nif (used()) { a(); }\n",
    # r: a caller of its wrapper is refused
    "r/one.ts": "export const wrapped = () => isEnabled('r');\n", "r/two.ts": "import { wrapped } from './one';\nwrapped().then(a);\nx = wrapped().y;\nb(wrapped() ? function () {} : c, q ? wrapped() : 1);\nwhile (wrapped()) { d(); } e(); function g() {}\n",
}


def test_a_run_follows_names(spark):
    files = spark.createDataFrame(list(CHAIN.items()), "path string, content string")
    rows = spark.createDataFrame([(k, "StuckRolledOut", True, "Dead", None, n) for n, k in enumerate("kmr")], "key string, reason string, treatment boolean, status string, blocked_by array<string>, seq long")
    out = remove.run(rows, files, READS)
    got = {(r.flag, r.path): r.after for r in out["rewrites"].collect()}
    assert {p: t.strip() for (f, p), t in got.items() if f == "k"} == {
        "src/flags.ts": "export const FLAGS = {\n  A: 'other',\n} as const;", "src/one.ts": "", "src/two.ts": "", "src/three.ts": "", "src/four.ts": "", "src/five.tsx": "export const P = () => <p>{1}</p>;",
        "src/six.ts": "function f(isOn) { return isOn(); }\nlog(f(g));", "p/flags.py": "OTHER = 'o'", "p/one.py": "from p.flags import OTHER", "p/two.py": "a()",
    }
    assert {p: t for (f, p), t in got.items() if f == "m"} == {"m/flags.ts": "export const MKEY = 'm';\nexport const used = () => true;\n", "m/use.ts": "import { used } from './flags';\nsend(used);\na();\n"}
    results = {r.key: r for r in out["results"].collect()}
    assert results["k"].action == "dry-run" and results["k"].unprocessed_files is None
    assert results["m"].unprocessed_files == ["m/flags.ts"]
    assert results["r"].action == "unsafe-rewrite" and results["r"].refused_files == ["r/two.ts"] and not [p for f, p in got if f == "r"]


def test_a_flag_in_one_file(spark):
    """A read in an if with else, as a candidate of an API names it: one proposal, and a diff that removes the read."""
    app = 'import { isEnabled } from "flags";\n\nexport function go(): string {\n  if (isEnabled("smoke-flag")) {\n    return "new";\n  }\n  return "old";\n}\n'
    files = spark.createDataFrame([("src/app.ts", app)], "path string, content string")
    rows = spark.createDataFrame([("smoke-flag", "StuckRolledOut", True, "Dead", None, 0)], "key string, reason string, treatment boolean, status string, blocked_by array<string>, seq long")
    out = remove.run(rows, files, READS, follow=False)
    (result,) = out["results"].collect()
    assert result.action == "dry-run" and '-  if (isEnabled("smoke-flag")) {' in result.diff and not [x for x in result.diff.splitlines() if x.startswith("+") and "isEnabled" in x]
    assert out["rewrites"].first().after == 'export function go(): string {\n  return "new";\n}\n'


def drop(**k):
    return {"member": "", "label": None, "position": None, "declared": False, "value": "true", **k}


@pytest.mark.parametrize(
    ("source", "drops", "after"),
    [
        ("export function f(a: number, on: boolean) { return on ? a : 3; }\nlog(f(1, true), x.f(2));\n", [drop(name="f", position=1, declared=True), drop(name="f", position=1)], "export function f(a: number) { return a; }\nlog(f(1), x.f(2));\n"),
        ("function f(on) { if (on) { a(); } const g = (on) => on; }\nf(false);\n", [drop(name="f", position=0, declared=True, value="false"), drop(name="f", position=0, value="false")], "function f() { const g = (on) => on; }\nf();\n"),
        ("const C = ({ on, q }: { on: boolean; q?: string }) => <p a={on}>{on && q}{f({ on })}</p>;\nconst z = <C on q={r} />;\nconst y = <C q={r} on={true}/>;\n", [drop(name="C", label="on", declared=True), drop(name="C", label="on")], "const C = ({ q }: { q?: string }) => <p a={true}>{q}{f({ on: true })}</p>;\nconst z = <C q={r} />;\nconst y = <C q={r} />;\n"),
        ("function f(on) { on = 1; }", [drop(name="f", position=0, declared=True)], None), ("function f(on) { g(`${on}`); }", [drop(name="f", position=0, declared=True)], None), ("function f(on) { on(); }", [drop(name="f", position=0, declared=True)], None),
        ("const C = ({ on }: Props) => on;", [drop(name="C", label="on", declared=True)], None),
    ],
)
def test_parameters_go_from_both_sides(source, drops, after):
    from sievewright.plans import parameters
    from sievewright.plans.fold import Refused

    if after is None:
        with pytest.raises(Refused):
            parameters.rewritten(source, "tsx", drops)
    else:
        assert parameters.rewritten(source, "tsx", drops) == after


def test_parameters_are_one_unit(spark):
    """A function whose own side can't be rewritten keeps its calls; one that is passed on, or that a call tells otherwise, is left."""
    from sievewright.plans import parameters

    texts = {
        "ok.ts": "export function ok(on: boolean) { return on ? 1 : 2; }\n", "bad.ts": "export function bad(on: boolean) { on = q; return on; }\n", "sent.ts": "export function sent(on: boolean) { return on; }\n", "mixed.ts": "export function mixed(on: boolean) { return on; }\n",
        "use.ts": "import { ok } from './ok';\nimport { bad } from './bad';\nimport { sent } from './sent';\nimport { mixed } from './mixed';\nlog(ok(isEnabled('k')), bad(isEnabled('k')), sent(isEnabled('k')), mixed(isEnabled('k')));\n",
        "other.ts": "import { sent } from './sent';\nimport { mixed } from './mixed';\nimport { ok as fine } from './ok';\nxs.map(sent);\nmixed(false);\nfine(true);\n",
    }
    files = spark.createDataFrame(list(texts.items()), "path string, content string")
    flags = spark.createDataFrame([("k", "k", True)], "key string, code_key string, treatment boolean")
    table = symbols.symbols(files.selectExpr("path", "'ts' AS language", "content"), READS).cache()
    assert parameters.read_sites(files.selectExpr("'f' AS flag", "path", "content")).where("kind = 'given'").count() == 6
    got = {r.path: r.after for r in spread.followed(flags, remove.pairs(flags, files), files, table, READS).collect()}
    assert got == {
        "ok.ts": "export function ok() { return 1; }\n", "other.ts": texts["other.ts"].replace("fine(true)", "fine()"),
        "use.ts": texts["use.ts"].split("log(")[0] + "log(ok(), bad(true), sent(true), mixed(true));\n",
    }
    table.unpersist()


@pytest.mark.parametrize(
    ("language", "source", "value", "blocks"),
    [
        ("ts", "if (!isEnabled('k')) { a(); }", True, ["{ a(); }"]), ("ts", "if (isEnabled('k')) { a(); } else { b(); }", True, ["{ b(); }"]), ("ts", "if (isEnabled('k')) { a(); } else if (x) { b(); }", True, []), ("ts", "if (isEnabled('k') && x) { a(); }", False, ["{ a(); }"]), ("ts", "if (isEnabled('k') && x) { a(); }", True, []), ("ts", "if (isEnabled('k')) a(); else b();", False, []),
        ("ts", "if (isEnabled('z')) { a(); }", False, []), ("java", 'if ((!flags.isEnabled("k"))) { if (isEnabled("k")) { a(); } }', True, ['{ if (isEnabled("k")) { a(); } }']), ("go", 'func f() {\nif !isEnabled("k") {\na()\n}\n}', True, ["{\na()\n}"]), ("kt", 'if (isEnabled("k")) { a() } else { b() }\n', False, ["{ a() }"]),
    ],
)
def test_blocks_are_predicted_and_deleted(language, source, value, blocks):
    from sievewright.plans import predicted

    found = predicted.dead_blocks(source, "k", value, READS, language)
    assert [source[a:b] for a, b in found] == blocks
    gone = fold(source, "k", value, READS, language).gone
    assert all(any(a <= s and e <= b for a, b in gone) for s, e in found)


def test_predictions_are_held_against_what_went(spark):
    from sievewright.plans import predicted

    spans = spark.createDataFrame([("f", "a", 5, 9), ("f", "a", 20, 30), ("f", "b", 5, 9), ("g", "a", 5, 9)], "flag string, path string, start int, end int")
    done = spark.createDataFrame([("f", "a", [(0, 10), (20, 29)]), ("f", "b", []), ("g", "a", None)], "flag string, path string, gone array<struct<start:int,end:int>>")
    assert sorted((r.flag, r.path, r.start) for r in predicted.unkept(spans, done).collect()) == [("f", "a", 20), ("f", "b", 5), ("g", "a", 5)]
    files = spark.createDataFrame([("f", "a", "KEY KEYS x.KEY(KEY)", "KEY"), ("f", "b", None, "KEY"), ("f", "c", "none", "KEY")], "flag string, path string, before string, code_key string")
    assert sorted(r.at for r in predicted.mentions(files).collect()) == [0, 11, 15]
    assert sorted(r.at for r in predicted.reported(files, spans.where("path = 'a' and start = 5").selectExpr("flag", "path", "10 AS start", "15 AS end")).collect()) == [0, 15]


def test_only_changed_files_are_read_again(spark, tmp_path):
    rows = [(f"src/f{k}.ts", "ts", f"export const K{k} = 'k{k}';\n") for k in range(20)] + [("src/same.ts", "ts", "export const K1 = 'k1';\n"), ("p.py", "python", "A = 'a'\n"), ("empty.ts", "ts", ""), ("null.ts", "ts", None), ("bad.ts", "ts", "f(")]
    make = lambda r: spark.createDataFrame(r, "path string, language string, content string")
    index, show = str(tmp_path / "index"), lambda df: sorted(map(str, df.select(*[x.split(" ")[0] for x in symbols.SYMBOLS.split(", ")]).collect()))
    want = show(symbols.symbols(make(rows), READS))
    for changed, read in ((rows, 24), (rows, 0), ([*rows[1:], ("src/f0.ts", "ts", "export const NEW = 'new';\n")], 1)):
        counter = spark.sparkContext.accumulator(0)
        got = show(symbols.indexed(make(changed), READS, index, counter))
        assert counter.value == read
        assert got == (want if changed is rows else show(symbols.symbols(make(changed), READS)))
    counter = spark.sparkContext.accumulator(0)
    symbols.indexed(make(rows[:3]), accessors("other")[0], index, counter).count()
    assert counter.value == 3


MAPS = {
    "base.ts": "export const BASE = { x: { y: 'k', z: 'other' }, 'top': 'k' };\n",
    "map.ts": "import { BASE } from './base';\nexport const MAP = { before: 'k', ...BASE, own: { deep: 'k' } };\n",
    "index.ts": "export { MAP as Flags } from './map';\n",
    "use.ts": "import { Flags } from './index';\nimport * as m from './map';\nlog(isEnabled(Flags.x.y), isEnabled(m.MAP.own.deep), isEnabled(Flags.top), isEnabled(Flags.before), isEnabled(Flags.x.z));\n",
    "solo.ts": "export const SOLO = { a: { lone: 'k', c: 'd' } };\n", "usesolo.ts": "import { SOLO } from './solo';\nlog(isEnabled(SOLO.a.lone), SOLO.a.c);\n",
    "whole.ts": "export const WHOLE = { a: { b: 'k', c: 'd' } };\n", "usewhole.ts": "import { WHOLE } from './whole';\nlog(isEnabled(WHOLE.a.b), Object.keys(WHOLE.a));\n",
}


def test_maps_are_read_through_spreads_and_levels(spark):
    files = spark.createDataFrame(list(MAPS.items()), "path string, content string")
    flags = spark.createDataFrame([("k", "k", True)], "key string, code_key string, treatment boolean")
    table = symbols.symbols(files.selectExpr("path", "'ts' AS language", "content"), READS).cache()
    got = {r.path: r.after for r in spread.followed(flags, remove.pairs(flags, files), files, table, READS).collect()}
    assert got["use.ts"].endswith("log(true, true, true, isEnabled(Flags.before), isEnabled(Flags.x.z));\n")  # what a spread may override is left
    assert got["usesolo.ts"].endswith("log(true, SOLO.a.c);\n") and got["solo.ts"] == "export const SOLO = { a: { c: 'd' } };\n"
    assert got["usewhole.ts"].endswith("log(true, Object.keys(WHOLE.a));\n") and got.get("whole.ts", MAPS["whole.ts"]) == MAPS["whole.ts"]
    assert got.get("base.ts", MAPS["base.ts"]) == MAPS["base.ts"]
    table.unpersist()
