"""Sources whose names differ in numbers are read once, and constant parameters come out as before however sites are summed."""

import pytest
from pyspark.sql import functions as F

from sievewright.operators import relational
from sievewright.plans import parameters, remove, spread, symbols
from sievewright.plans.alike import alike, rows_alike
from sievewright.plans.fold import MARKUP, Known
from sievewright.sources import checkout
from sievewright.sources.config import Accessor

READS = [Accessor("isEnabled")]


def test_folds_of_sources_whose_names_end_with_numbers_are_made_twice_at_most():
    calls = []

    def plain(source, key, value, language, known):
        calls.append(source)
        return remove._one(source, key, value, language, READS, [], [], known)

    fold = alike(plain)
    for k in range(7, 2007):
        got = fold(f"import {{ show{k} }} from './f/c{k}';\nlog(show{k}({k * 3}, isEnabled('k')));\n", "k", True, "ts", ())
        assert got[0] == f"import {{ show{k} }} from './f/c{k}';\nlog(show{k}({k * 3}, true));\n"
    assert len(calls) <= 2 * 2


@pytest.mark.parametrize("source", [
    "import { show# } from './f/c#';\nlog(show#(#, isEnabled('k')));\n",
    "import * as ns# from '../f/c#';\nns#.show#(true, x#.y#);\nexport { ns# as n# };\n",
    "export function show#(a#: number, on: boolean) { return on ? a# : 0x#; }\nshow#(1e#, false); show#(-#, 1.5);\n",
    "export const KEY# = 'k#', T = `x${KEY#}y#`;\nf(isEnabled(KEY#), isEnabled2('k#'), $x#, a$#);\n",
    "const o# = { a#: 'v#', b: 'w\\x#' }; // o# is on\nexport default o#;\n",
    "export function P#({ on#, a }) { return <Q# on# b={true} c='x#'/>; }\nconst e = <P# on# a={#}/>;\n",
    "import { a# } from './m#';\nconst f = (a#) => a#(#); g(a#, '#', '-#', 'q.#');\n",
    "f(#",
])
def test_alike_sources_have_the_symbols_and_sites_that_they_have_alone(source):
    reads = [Accessor("isEnabled"), Accessor("isEnabled2")]

    def plain(source, language):
        return symbols.read_one(source, language, reads), parameters.tally(source, language)

    once = rows_alike(plain, MARKUP, map(repr, reads))
    for numbers in ("1234567", "2222222", "70001", "05", "121212", "2", "3", "44"):
        text = source
        for n in numbers * 3:
            text = text.replace("#", n if len(numbers) < 7 else n * 2, 1)
        for language in ("ts", "tsx"):
            found, sites = once(language, (), text)
            want, held = plain(text, language)
            assert ([tuple(x) for x in found], [tuple(x) for x in sites]) == ([tuple(x) for x in want], held)


@pytest.mark.parametrize("key", ["k5", "flag-3", "5", "n7"])
def test_numbers_in_keys_and_known_names_stay_what_they_are(key):
    known = (Known("on5", "", "value", True), Known("M", "KEY7", "key"))
    plain = lambda *asked: remove._one(*asked[:4], READS, [], [], asked[4])
    fold = alike(plain, map(repr, READS))
    for n in (3, 5, 7, 35, 55, 77, 12, 5):
        for word in ("k", "flag-", "", "n"):
            source = f"if (isEnabled('{word}{n}')) {{ a{n}({n}); }} else {{ b(on{n}, isEnabled(M.KEY{n})); }}\nit('shows {n} when {word}{n} is on', () => f({n}));\nf(on{n} ? 'x{n}' : {word[:1] or 'q'}{n});\n"
            for names in ((), known):
                assert fold(source, key, True, "ts", names) == plain(source, key, True, "ts", names)


def _followed(spark, files, flags, held=False):
    files = relational.checkpointed(spark.createDataFrame(list(files.items()), "path string, content string"))
    flags = spark.createDataFrame(flags, "key string, code_key string, treatment boolean")
    named = files.withColumn("language", checkout.language(F.col("path")))
    read = relational.checkpointed(parameters.read(named, READS))
    table = read.select("path", F.inline("symbols")) if held else relational.checkpointed(symbols.symbols(named, READS))
    assert {tuple(r) for r in read.select("path", F.inline("symbols")).collect()} == {tuple(r) for r in symbols.symbols(named, READS).collect()}
    done = spread.followed(flags, remove.pairs(flags, files), files, table, READS, held=read if held else None)
    return {(r.flag, r.path): r.after for r in done.where("reason is null").collect() if r.after != r.before}


@pytest.mark.parametrize("held", [False, True])
def test_calls_of_one_file_that_disagree_keep_the_parameter(spark, held):
    files = {
        "m.ts": "export function both(a, on) { return on ? a : 0; }\nexport function same(a, on) { return on ? a : 0; }\nexport function was(a, on) { return on ? a : 0; }\n",
        "a.ts": "import { both, same } from './m';\nboth(1, isEnabled('k')); both(2, !isEnabled('k'));\nsame(1, isEnabled('k')); same(2, isEnabled('k'));\n",
        "b.ts": "import * as ns from './m';\nns.same(3, isEnabled('k')); ns.was(4, true); log(isEnabled('k'));\n",
        "c.ts": "import { was as w } from './m';\nw(5, true);\n",
        "d.ts": "import { both } from './m';\nimport { same } from './unknown';\nsame(6, 7, 8); isEnabled('q');\n",
    }
    got = _followed(spark, files, [("k", "k", True), ("q", "q", False)], held)
    assert got["k", "m.ts"] == files["m.ts"].replace("same(a, on) { return on ? a : 0; }", "same(a) { return a; }")
    assert got["k", "a.ts"] == "import { both, same } from './m';\nboth(1, true); both(2, false);\nsame(1); same(2);\n"
    assert got["k", "b.ts"] == "import * as ns from './m';\nns.same(3); ns.was(4, true); log(true);\n"
    assert ("k", "c.ts") not in got and ("q", "m.ts") not in got


def test_joins_of_a_run_leave_the_setting_as_it_was(spark):
    name = "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold"
    before = spark.conf.get(name)
    with relational.hashed(spark):
        assert spark.conf.get(name) == f"{relational.HASHED}b"
    assert spark.conf.get(name) == before
