"""Sources that differ in numbers alone are folded once, and each comes out as by a fold of its own."""

import pytest
from pyspark.sql import functions as F

from sievewright.plans import remove, slices
from sievewright.plans.alike import alike
from sievewright.plans.fold import Known, Refused
from sievewright.sources.config import Accessor

READS = [Accessor("isEnabled")]


def _plain(source, key, value, language="ts", known=()):
    return remove._one(source, key, value, language, READS, [], [], known)


def _counted():
    calls = []

    def fold(*asked):
        calls.append(asked)
        return _plain(*asked)

    return alike(fold), calls


def test_reads_that_differ_in_numbers_are_folded_twice_at_most():
    fold, calls = _counted()
    for k in range(2000):
        got = fold(f"const v = client.isEnabled('flag-3') ? a({k * 37}) : b;\n", "flag-3", False, "ts", ())
        assert got[0] == "const v = b;\n" and got[1] == 1
    assert len(calls) == 2


@pytest.mark.parametrize("source", [
    "if (isEnabled('k')) { a(#, #); } else { b(#); }\nf(#);",
    "f(isEnabled('k') ? # : #) - #; x[#] = 1.5 + 0x1F;",
    "const on = isEnabled('k'); g(on, #, { on: # }); const s = `{#}`; // # k",
    "// # is on\nif (isEnabled('k')) { return # }\nreturn #;",
    "const s = '#'; f(isEnabled('k') && #);",
    "x = a / # / b; y = /#/g; f(isEnabled('k') || #);",
    "it('shows # when k is on', () => { f(isEnabled('k'), #); });",
    "f(ON ? # : b, isEnabled(NAME) && #, #);",
    "f(#, {0}, isEnabled('k'));",
    "x(isEnabled('k').a, #);",
    "x(isEnabled('k') ? (#;",
])
def test_alike_sources_come_out_as_by_a_fold_of_their_own(source):
    def told(fold, *asked):
        try:
            return fold(*asked)
        except Exception as e:
            return type(e), str(e)

    known = (Known("ON", "", "value", True), Known("NAME", "", "key"))
    for key in ("k", "12", "70001"):
        fold, _ = _counted()
        for numbers in ((1, 2, 3, 4), (12, 12, 12, 12), (70001, 7000100000, 7000100001, 0), (123456789012, 5, 99, 100)):
            text = source.replace("'k'", f"'{key}'")
            for n in numbers:
                text = text.replace("#", str(n), 1)
            for language in ("ts", "tsx", "java", "kt", "swift", "go"):
                for value in (True, False):
                    for names in ((), known):
                        asked = (text, key, value, language, names)
                        assert told(fold, *asked) == told(_plain, *asked)


def test_refused_and_unreadable_sources_keep_their_own_reasons():
    fold, _ = _counted()
    for k in (5, 60, 700):
        with pytest.raises(Refused):
            fold(f"x({k}, isEnabled('k').a);", "k", True, "ts", ())


def test_calls_without_effects_are_told_apart_by_their_numbers(spark):
    source = F.concat(F.lit("if (isEnabled('k')) { log("), "id", F.lit("); } log(7);\n"))
    rows = spark.range(5, 9).select(F.lit("k").alias("flag"), F.lit("k").alias("code_key"), F.lit(True).alias("treatment"), F.col("id").cast("string").alias("path"), F.lit("ts").alias("language"), source.alias("before"))
    got = {r.path: r.after for r in remove.folded(rows, READS, inert=["log"]).collect()}
    assert got == {r.path: remove._one(r.before, "k", True, "ts", READS, [], ["log"], [])[0] for r in rows.collect()}


def test_rows_of_alike_files_have_their_own_stretches_and_findings(spark):
    source = F.concat(F.lit("f("), "id", F.lit(");\nif (isEnabled('k')) { a("), "id", F.lit("); } else { b("), F.col("id") * 1000, F.lit("); }\nf(c?.isEnabled('k'));\nconst on = isEnabled('k');\nexport const off = !isEnabled('k');\n"))
    rows = spark.range(0, 300, numPartitions=1).select(F.lit("k").alias("flag"), F.lit("k").alias("code_key"), F.lit(True).alias("treatment"), F.col("id").cast("string").alias("path"), F.lit("ts").alias("language"), source.alias("before"))
    got = remove.folded(rows, READS).collect()
    assert len(got) == 300
    for r in got:
        after, n, reason, findings, left, made, gone = _plain(r.before, "k", True)
        assert (r.flag, r.after, r.reads, r.reason, r.left) == ("k", after, n, reason, left) and n and made and gone
        assert ([tuple(x) for x in r.findings], [tuple(x) for x in r.made], [tuple(x) for x in r.gone]) == (findings, made, gone)


def test_each_shape_is_folded_twice_at_most_for_each_value():
    fold, calls = _counted()
    for k in range(3200):
        before, on, off = (x.replace("#", str(k * 11)) for x in slices.SHAPES[k % len(slices.SHAPES)])
        assert fold(before, "k", k % 3 == 0, "ts", ())[0] == (on if k % 3 == 0 else off)
    assert len(calls) == 2 * 2 * len(slices.SHAPES)
