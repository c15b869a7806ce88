"""What used to be capped: chains, names, short items; and keys that are null, in another case, or written twice."""

from sievewright.functions import text
from sievewright.operators import archive, candidates, mentions, passages, relational, resolve


def test_long_and_circular_reexports(spark):
    chain = [(f"m{k}", "x", f"m{k + 1}") for k in range(45)] + [("m45", "x", None)]
    rest = [("a", "x", "b"), ("b", "x", "a"), ("c", "x", "nowhere"), ("m3", "y", None)]
    exports = spark.createDataFrame(chain + rest, "module string, name string, source string")
    imports = spark.createDataFrame([("r1", "x", "m0"), ("r2", "x", "a"), ("r3", "x", "c"), ("r4", "y", "m3"), ("r5", "x", "zz"), ("r6", "x", "m45")], "reader string, name string, module string")
    got = {r.reader: r.module for r in resolve.provider(imports, exports).collect()}
    assert got == {"r1": "m45", "r2": None, "r3": None, "r4": "m3", "r5": None, "r6": "m45"}


def test_null_is_a_key(spark):
    df = spark.createDataFrame([(None, 1), ("a", 2), ("a", 3), ("b", 4)], "k string, v int")
    assert sorted(r.v for r in relational.unique(df, ["k"]).collect()) == [1, 4]
    assert sorted(r.v for r in relational.unique(df.union(df.where("k is null")), ["k"]).collect()) == [4]


def test_names_of_several_tokens_and_of_none(spark, monkeypatch):
    monkeypatch.setattr(mentions, "FEW", 2)
    monkeypatch.setattr(mentions, "BLOCK", 2)
    files = spark.createDataFrame([("a", "x a.b y"), ("b", "xa.b a-b"), ("c", "a.bc +++ &&"), ("d", None), ("e", "b a.b")], "path string, content string")
    names = [("a.b",), ("a-b",), ("b",), ("+++",), ("&&",), ("--",), ("a.b.c",), (None,)]
    got = {(r.path, r.name) for r in mentions.mention_files(files, spark.createDataFrame(names, "name string")).collect()}
    assert got == {("a", "a.b"), ("a", "b"), ("b", "b"), ("b", "a-b"), ("c", "+++"), ("c", "&&"), ("e", "b"), ("e", "a.b"), ("d", None)}


def test_many_short_items(spark, monkeypatch):
    monkeypatch.setattr(passages, "BLOCK", 3)
    docs = spark.createDataFrame([(1, "one two three"), (2, "twofold"), (3, None)], "doc_id long, text string")
    items = [(k, t) for k, t in enumerate(["one", "two", "two three", "four", "wo", "fold", "e t", "one two three", None])]
    got = {(r.item_id, r.doc_id) for r in passages.containing(docs, spark.createDataFrame(items, "item_id long, text string"), "doc_id", "item_id").collect()}
    assert got == {(k, d) for k, t in items if t for d, x in ((1, "one two three"), (2, "twofold")) if t in x}


def test_ancestors_of_tips_alone(spark):
    commits = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "b"), ("e", "c"), ("e", "d"), ("x", "y")], "sha string, parent string")
    got = sorted(tuple(r) for r in archive.ancestry(commits, spark.createDataFrame([("e",), ("b",)], "sha string")).collect())
    assert got == [("b", "a"), ("e", "a"), ("e", "b"), ("e", "c"), ("e", "d")]


def test_lists_by_beginning(spark):
    from sievewright import model

    rows = spark.createDataFrame([(k, "", True, "Dead", [], i) for i, k in enumerate(["old-a", "old", "new-a", "new", "x"])], model.CANDIDATES)
    got = [r.action for r in candidates.decide(rows, ["old-*"], ["new*", "old"]).orderBy("seq").collect()]
    assert got == ["ignored", None, None, None, "not-selected"]


def test_keys_of_json_sections():
    cut = text.remove_keys
    assert cut('{"s": {"Flag": 1, "b": 2}, "t": 3}', "S", ["flag"]) == ('{"s": {"b": 2}, "t": 3}', ["Flag"])
    assert cut('{"F": {"Flag": 1}, "t": 3}', "F", ["flag"]) == ('{"t": 3}', ["Flag"])
    assert cut('{"t": 3, "F": {"flag": 1} }', "F", ["flag"]) == ('{"t": 3 }', ["flag"])
    assert cut('{"a": {"F": {"flag": 1, "g": 2}}}', "a.F", ["flag", "G"]) == ('{"a": {}}', ["flag", "g"])
    twice = '{"s": {"flag": 1, "Flag": 2}}'
    assert cut(twice, "s", ["flag"]) == (twice, []) and cut("{", "s", ["flag"]) == ("{", []) and cut("[]", "", ["x"]) == ("[]", [])
    assert cut('{"flag": 1}', "", ["flag"]) == ("{}", ["flag"])
    assert cut('{ // c\n "a": 1, /* k */ "b": [1, "}"], "c": 2 }', "", ["b", "c"]) == ('{ // c\n "a": 1 }', ["b", "c"])
