import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievewright.functions import comments, keys, scanner, text, tokens
from sievewright.operators import archive


@given(st.text(max_size=40))
@settings(max_examples=300, deadline=None)
def test_branch_escape_is_a_bijection(key):
    out = keys.escape(key)
    if out is None:
        assert not key.strip() or len(key.encode()) * 3 > keys.LONGEST
    else:
        assert keys.unescape(out) == key


@pytest.mark.parametrize("segment", ["=6F=6C=64", "a=2f", "a=2", "a b", "", "=FF", "=20", "x" * 241])
def test_segments_that_no_key_has(segment):
    assert keys.unescape(segment) is None


def test_branch_columns(spark):
    rows = spark.createDataFrame([("old-checkout",), ("a/b",), (" ",), ("é",), (None,)], "k string")
    got = rows.select("k", keys.removal_branch(F.col("k")).alias("b")).select("k", "b", keys.key_of_branch(F.col("b")).alias("back")).collect()
    assert [r.back for r in got] == ["old-checkout", "a/b", None, "é", None]
    assert got[1].b == keys.BRANCH_PREFIX + "a=2Fb"


def test_token_boundaries(spark):
    rows = [("x new-ui y", True), ("new-ui-2", False), ("a-new-ui", False), ("anew-ui", False), ("(new-ui)", True), ("new.ui", False), (None, None)]
    df = spark.createDataFrame(rows, "t string, want boolean")
    assert all(r.got == r.want for r in df.select("want", tokens.mentions_key(F.col("t"), "new-ui").alias("got")).collect())
    assert [r[0] for r in df.where("t is null").select(tokens.mentions_key(F.col("t"), "new-ui", True)).collect()] == [True]
    uni = spark.createDataFrame([("énew",), (".new",), ("new!",)], "t string").select(tokens.key_token(F.col("t"), "new")).collect()
    assert [r[0] for r in uni] == [False, False, True]
    some = spark.createDataFrame([("$NAME$x",), ("NAMES",)], "t string").select(tokens.mentions_any(F.col("t"), ["NAME"]), tokens.mentions_any(F.col("t"), [])).collect()
    assert [tuple(r) for r in some] == [(True, False), (False, False)]


def test_lines_and_diffs(spark):
    df = spark.createDataFrame([("a\nb\n",), ("a b",), ("",), ("\n",), ("x\r\ny",)], "t string")
    assert [r[0] for r in df.select(text.lines(F.col("t"))).collect()] == [["a", "b"], ["a b"], [], [""], ["x\r", "y"]]
    assert text.unified("f", "a\n", "a\n") == ""
    out = text.unified("f", "a\nb", "a\nc")
    assert "\\ No newline at end of file" in out and "+c" in out and "-b" in out
    assert "+++ /dev/null" in text.unified("f", "a\n", None)
    found = spark.createDataFrame([("one\ntwo needle\nneedle",), ("none",)], "t string").select(text.line_of(F.col("t"), F.lit("needle")).alias("f")).collect()
    assert (found[0].f.line, found[0].f.text) == (2, "two needle") and found[1].f is None


@pytest.mark.parametrize(
    ("source", "section", "want"),
    [
        ('{"a": 1, // one\n "b": {"k": [1, 2]}, "c": 3}', "", '{"a": 1, // one\n "c": 3}'),
        ('{"a": {"x": 1, "b": 2}}', "a", '{"a": {"x": 1}}'),
        ('{"b": 1}', "", "{}"),
        ('{"b": 1,}', "", "{}"),
        ('{"a": "b", /* b */ "z": "}"}', "", '{"a": "b", /* b */ "z": "}"}'),
        ("not json", "", "not json"),
        ("", "", ""),
    ],
)
def test_json_with_comments(source, section, want):
    assert text.remove_keys(source, section, ["b"])[0] == want


def test_depth(spark):
    df = spark.createDataFrame([("f(a[{}])",), (")))((",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(text.depth("t")).collect()] == [3, 0, 0, None]


def test_scanner_round_trip():
    source = "const a = `x${f({b: `}`})}y`; // c\nconst r = /[/]x/g; if (a) { g('\\'') } /* } */"
    assert scanner.text(*scanner.scan(source)) == source
    for bad in ("f(", ")", "`x", "{]"):
        with pytest.raises(scanner.Unreadable):
            scanner.scan(bad)


def test_comments():
    assert comments.without_sentence("Uses my-flag here. Keep this.", "my-flag") == "Keep this."
    assert comments.without_item("flags: aa, my-flag and bb", "my-flag", frozenset({"aa", "bb"})) == "flags: aa and bb"
    assert comments.without_item("x, my-flag and prose", "my-flag") == "x, my-flag and prose"
    assert comments.without_item("with a=1, my-flag=2", "my-flag") == "with a=1"
    assert comments.without_clause("Keep this, see my-flag; and that", "my-flag") == "Keep this; and that"
    assert comments.delete_only("// my-flag is on\nx\n// my-flag. But this.\n", "my-flag") == "x\n// my-flag. But this.\n"
    assert comments.titles("it('works when my-flag is on', f)", "my-flag") == "it('works', f)"
    assert comments.only_in_comments("// my-flag\nx", "my-flag") is True
    assert comments.only_in_comments("f('my-flag')", "my-flag") is False
    assert comments.only_in_comments("my-flag", "my-flag") is False
    assert comments.only_in_comments("(", "x") is False
    assert comments.only_in_comments("( x", "x") is None
    assert comments.only_in_comments(None, "x") is None


def test_commands(spark):
    bodies = [("@sievewright rerun", "rerun"), ("we should @sievewright rerun", None), ("hi\n  @Sievewright   Recreate  \nbye", "recreate"), ("@sievewrightrerun", None),
              ("@sievewright rerun please", None), ("```\n@sievewright rerun\n```", None), ("    @sievewright rerun", None), ("<!-- \n@sievewright rerun\n-->", None), (None, None)]
    df = spark.createDataFrame(bodies, "b string, want string")
    assert [r[0] for r in df.select(archive.command(F.col("b"))).collect()] == [w for _, w in bodies]


def test_generated(spark):
    df = spark.createDataFrame([("// Code generated by x. DO NOT EDIT.\n", "a.go"), ("x", "a.pb.go"), ("x", "a.go")], "s string, p string")
    assert [r[0] for r in df.select(comments.is_generated(F.col("s"), F.col("p"))).collect()] == [True, True, False]
