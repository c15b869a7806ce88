import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sievewright import model
from sievewright.functions import keys
from sievewright.operators import agreement, archive, candidates, mentions, passages, relational, report, resolve


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def test_decide_in_order(spark):
    data = [("deny", ["x"]), ("other", []), (" ", []), ("a", []), ("a", []), ("held", ["y"]), ("done", []), ("open", [])]
    c = spark.createDataFrame([(k, "", True, "Dead", b, i) for i, (k, b) in enumerate(data)], model.CANDIDATES)
    handled = spark.createDataFrame([(keys.BRANCH_PREFIX + "done",)], "branch string")
    allow = ["deny", " ", "a", "held", "done", "open"]
    got = candidates.decide(c, ["deny"], allow, handled=handled).orderBy("seq").collect()
    assert [r.action for r in got] == ["ignored", "not-selected", "unsafe-key", None, "duplicate", "blocked", "already-handled", None]


def test_alias_of_another_flag(spark):
    c = spark.createDataFrame([("a", "", True, "Dead", [], 0), ("b", "", True, "Dead", [], 1)], model.CANDIDATES)
    known = spark.createDataFrame([("a",), ("b",), ("B_CODE",)], "key string")
    got = candidates.decide(c, aliases={"b": "B_CODE"}, known=known).orderBy("seq").collect()
    assert [(r.code_key, r.action) for r in got] == [("a", None), ("B_CODE", "unsafe-key")]


@pytest.mark.parametrize("most", [0, 1, 3, 100])
def test_conditional_limit(spark, most):
    rnd = random.Random(7)
    data = [(i, rnd.random() < 0.3) for i in range(500)]
    want, n = [], 0
    for i, hit in data:
        want.append(i)
        n += hit
        if most and n >= most:
            break
    df = spark.createDataFrame(rnd.sample(data, len(data)), "seq long, hit boolean")
    assert [r[0] for r in rows(relational.limited(df, F.col("seq"), F.col("hit"), most, ["seq"]), "seq")] == want


def test_running_total_of_ties_and_nulls(spark):
    df = spark.createDataFrame([(1, 1, 5), (1, 2, 6), (2, 3, None), (None, 4, 1)], "o int, id int, v int")
    got = {r.id: r.t for r in relational.running_total(df, F.col("o"), F.col("v"), "t", ["id"]).collect()}
    assert got == {4: 1, 1: 6, 2: 12, 3: 12}


def test_first_unique_proven_agreed(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 3, None), ("c", 4, "z"), ("c", 5, "z")], "k string, seq int, v string")
    assert rows(relational.first_by(df, ["k"], ["seq"])) == [("a", 1, "y"), ("b", 3, None), ("c", 4, "z")]
    assert rows(relational.unique(df, ["k"]), "k") == [("b",)]
    assert rows(relational.proven(df, ["k"], F.col("v") > "w")) == [("a", 2), ("c", 2)]
    assert {r.k: r.v for r in relational.agreed(df, ["k"], "v").collect()} == {"a": None, "b": None, "c": "z"}


def test_closure_and_follow(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "src string, dst string")
    start = spark.createDataFrame([("a",)], "node string")
    assert rows(relational.closure(edges, start)) == [("a",), ("b",), ("c",)]
    links = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(30)] + [("p", "q"), ("q", "p")], "src string, dst string")
    asked = spark.createDataFrame([("n0",), ("n29",), ("p",), ("alone",)], "node string")
    assert {r.name: r.end for r in relational.follow(links, asked).collect()} == {"n0": "n30", "n29": "n30", "p": None, "alone": "alone"}


def test_spans_and_prefixes(spark):
    rnd = random.Random(3)
    spans = [(rnd.choice("ab"), s := rnd.randrange(9000), s + rnd.randrange(0, 6000)) for _ in range(60)]
    points = [(k, i, rnd.randrange(16000)) for i, k in enumerate(rnd.choices("abc", k=120))]
    s = spark.createDataFrame(spans, "path string, start int, end int")
    p = spark.createDataFrame(points, "path string, id int, at int")
    want = sorted((i, a, b) for k, i, x in points for q, a, b in spans if q == k and a <= x < b)
    assert rows(relational.contained(p, s, "path", "at", "start", "end"), "id", "start", "end") == want
    assert rows(relational.outside(p, s, "path", "at", "start", "end"), "id") == sorted({(i,) for _, i, _ in points} - {(i,) for i, _, _ in want})
    files = spark.createDataFrame([("a/b/c.ts",), ("a/x.ts",), ("z.ts",)], "path string")
    modules = spark.createDataFrame([("a", "A"), ("a/b", "AB")], "directory string, module string")
    assert {r.path: r.module for r in resolve.modules_of(files, modules).collect()} == {"a/b/c.ts": "AB", "a/x.ts": "A", "z.ts": None}


@pytest.mark.parametrize("few", [0, 32])
def test_mentions_by_token_join(spark, monkeypatch, few):
    monkeypatch.setattr(mentions, "FEW", few)
    files = spark.createDataFrame([("1", "f(NAME)"), ("2", "NAMES"), ("3", None), ("4", "a.b c")], "path string, content string")
    names = spark.createDataFrame([("NAME",), ("a.b",), ("zz",)], "name string")
    assert rows(mentions.mention_files(files, names).where("name is not null")) == [("1", "NAME"), ("4", "a.b")]
    assert [r.path for r in mentions.mention_files(files, names).where("name is null").collect()] == ["3"]
    assert rows(mentions.mention_count(files, names)) == [("NAME", 2), ("a.b", 2), ("zz", 1)]
    renames = spark.createDataFrame([("NAME", "ALIAS"), ("ALIAS", "LAST")], "original string, alias string")
    assert rows(mentions.with_aliases(names.where("name = 'NAME'"), renames)) == [("ALIAS",), ("LAST",), ("NAME",)]


def test_unprocessed_keeps_the_first_spelling(spark):
    a = spark.createDataFrame([("x/../f", "/f", 0), ("g", "/g", 1)], "path string, resolved string, seq int")
    b = spark.createDataFrame([("f", "/f", 0), ("h", "/h", 1)], "path string, resolved string, seq int")
    assert rows(mentions.unprocessed(a, b), "path") == [("g",), ("h",), ("x/../f",)]


def declared(spark, names):
    return spark.createDataFrame([(p, "m", "o", n, n.lower()) for p, n in names], "path string, module string, owner string, name string, key string")


def test_resolution(spark):
    d = declared(spark, [("a", "ONE"), ("b", "TWICE"), ("c", "TWICE"), ("d", "SEEN"), ("e", "OWN")])
    refs = spark.createDataFrame([("r", "m", "o", "ONE", True), ("e", "m", "o", "OWN", False)], "path string, module string, owner string, name string, removable boolean")
    files = spark.createDataFrame([("a", "ONE"), ("r", "f(ONE)"), ("s", "SEEN in text"), ("d", "SEEN"), ("e", "OWN OWN")], "path string, content string")
    got = resolve.resolve(d, refs, files)
    assert rows(got["deletable"], "name") == [("ONE",)]
    assert {r.name: r.reason for r in got["blocked"].collect()} == {"TWICE": "declared more than once", "SEEN": "a mention isn't proven", "OWN": "a use in its own file stays"}
    blind = resolve.resolve(d, refs, files.union(spark.createDataFrame([("u", None)], "path string, content string")))
    assert blind["deletable"].count() == 0


def test_providers(spark):
    imports = spark.createDataFrame([("r", "x", "index"), ("r", "y", "index"), ("r", "z", "loop")], "reader string, name string, module string")
    exports = spark.createDataFrame([("index", "x", "lib"), ("lib", "x", None), ("index", "y", "nowhere"), ("loop", "z", "pool"), ("pool", "z", "loop")], "module string, name string, source string")
    assert {r.name: r.module for r in resolve.provider(imports, exports).collect()} == {"x": "lib", "y": None, "z": None}
    asked = spark.createDataFrame([("r", "@a/b/c"), ("r", "none")], "reader string, specifier string")
    packages = spark.createDataFrame([("@a/b", "pkg/src"), ("@a", "wrong")], "package string, source string")
    assert {r.specifier: r.source for r in resolve.workspace_source(asked, packages).collect()} == {"@a/b/c": "pkg/src", "none": None}


def test_gates(spark):
    f = spark.createDataFrame([("f", "a", "x", "y", None), ("f", "b", "x", "z", "bad"), ("g", "c", "q", "q", None)], model.REWRITES)
    assert rows(agreement.all_or_nothing(f), "path") == [("c",)]
    assert agreement.refused_flags(f).first().refusal_reasons[0].file == "b"
    uses = spark.createDataFrame([("p", "A", True, None), ("p", "A", False, True), ("p", "B", True, None), ("p", "B", True, None), ("p", "C", True, None), ("p", "C", False, None)], "path string, name string, binds boolean, removable boolean")
    assert rows(agreement.binding_safe(uses), "name") == [("A",)]
    assert {r.name: r.reason for r in agreement.withheld(uses).collect()} == {"B": "bound more than once", "C": "used where it can't be removed"}
    fused = spark.createDataFrame([("f", "a", "return x", "returnx", None)], model.REWRITES)
    assert agreement.fused_names(fused).first().names == ["returnx"]
    said = spark.createDataFrame([("toBeTruthy", True), ("toBeFalsy", True), ("toThrow", True)], "e string, v boolean").select(agreement.judge(F.col("e"), F.col("v"))).collect()
    assert [r[0] for r in said] == [True, False, None]


def test_archive(spark):
    live = spark.createDataFrame([("a",), ("b/c",), ("d",)], "key string")
    merged = spark.createDataFrame([(keys.BRANCH_PREFIX + "a", "main", 1, "u1", "s1"), (keys.BRANCH_PREFIX + "a", "main", 5, "u5", "s5"), (keys.BRANCH_PREFIX + "b=2Fc", "main", 2, "u2", "s2"), (keys.BRANCH_PREFIX + "d", "dev", 3, "u3", "s3")], model.MERGED)
    out = archive.outstanding(live, merged, "main")
    assert rows(out, "key", "pull_request") == [("a", 5), ("b/c", 2)]
    commits = spark.createDataFrame([("t1", "s5"), ("s5", "s2"), ("t2", "s2"), ("s2", None)], "sha string, parent string")
    refs = spark.createDataFrame([("prod", "t1", 0), ("eu", "t2", 1)], "ref string, sha string, seq int")
    reach = archive.ancestry(commits, refs)
    assert rows(reach) == [("t1", "s2"), ("t1", "s5"), ("t2", "s2")]
    yes, no = archive.by_containment(out, refs, reach)
    assert rows(yes, "key") == [("b/c",)] and rows(no, "key", "missing") == [("a", "eu")]
    assert archive.archive_each(out, lambda k: "unauthorized" if k == "a" else "archived") == [("a", "unauthorized"), ("b/c", "not-attempted")]

    def fail(key):
        if key == "a":
            raise OSError("down")
        return "archived"

    assert archive.archive_each(out, fail) == [("a", "failed: down"), ("b/c", "archived")]


def test_holds(spark):
    t = lambda n: datetime(2024, 1, n)
    c = spark.createDataFrame([(1, "bot", True, t(1), "<!-- flag-hold draft=true -->"), (2, "bot", True, t(1), "<!-- flag-hold draft=false -->"), (2, "bot", True, t(2), archive.RELEASE_MARKER), (3, "me", False, t(1), "<!-- flag-hold draft=true -->"), (4, "bot", True, t(2), "<!-- flag-hold draft=false -->"), (4, "bot", True, t(1), archive.RELEASE_MARKER)], model.COMMENTS)
    assert rows(archive.active_holds(c)) == [(1, True), (4, False)]


def test_passages(spark):
    d = spark.createDataFrame([(1, "xx one two three four five six seven yy"), (2, "one two"), (3, None)], "doc_id int, text string")
    i = spark.createDataFrame([(1, "one two three four five six seven"), (2, "x one two three four five six sev"), (3, "o t"), (4, "ne two"), (5, None)], "item_id int, text string")
    assert rows(passages.containing(d, i, "doc_id", "item_id"), "item_id", "doc_id") == [(1, 1), (2, 1), (3, 1), (4, 1), (4, 2)]


def test_report(spark):
    r = spark.createDataFrame([("dry-run",), ("ignored",), ("dry-run",)], "action string")
    assert report.summary(r, "dead") == "3 candidates: 2 dry-run, 1 ignored"
    assert report.summary(r.where("false"), "dead") == "0 removal candidates (staleness=dead), nothing to do"
    f = spark.createDataFrame([("k", "p", 3, "kept", "why", None)], model.FINDINGS)
    body = report.bodies(spark.createDataFrame([("k", True)], "key string, treatment boolean"), f).first().body
    assert "### kept" in body and "- `p:3` why" in body


def test_holds_of_requests(spark):
    from sievewright.operators import requests

    t = lambda n: datetime(2024, 1, n)
    pulls = spark.createDataFrame(
        [(1, "a", False, ["x", "y"], True), (2, "b", True, ["x"], True), (3, "c", True, [], True), (4, "d", True, [], True), (5, "e", False, ["x"], True), (6, "f", False, ["x"], False), (7, "g", None, None, None), (8, "h", True, ["x"], True)],
        "pull long, key string, draft boolean, blocked_by array<string>, comments_read boolean",
    )
    said = spark.createDataFrame(
        [(3, "bot", True, t(1), "<!-- flag-hold draft=false -->"), (4, "bot", True, t(1), "<!-- flag-hold draft=true -->"), (5, "bot", True, t(1), "<!-- flag-hold draft=false -->"), (8, "bot", True, t(1), "<!-- flag-hold draft=false -->"), (8, "bot", True, t(2), archive.RELEASE_MARKER)],
        model.COMMENTS,
    )
    actions = requests.hold_actions(pulls, said)
    got = {r.pull: (r.action, r.set_draft) for r in actions.collect()}
    assert got == {1: ("hold", True), 2: ("hold", None), 3: ("release", False), 4: ("release", None), 5: ("ready-by-hand", None), 6: ("unread", None), 8: ("hold", None)}
    bodies = {r.pull: r.body for r in actions.collect()}
    assert "`x`, `y`" in bodies[1] and bodies[5] is None
    written = spark.createDataFrame([(p, "bot", True, t(3), b) for p, b in bodies.items() if b], model.COMMENTS)
    assert rows(archive.active_holds(written)) == [(1, False), (2, True), (8, True)]
    log = []
    done = requests.apply_holds(actions, lambda p, d: log.append((p, d)) or p != 3, lambda p, b: p != 1)
    assert done == [(1, "no-comment"), (2, "hold"), (3, "refused"), (4, "release"), (8, "hold")] and log == [(1, True), (1, False), (3, False)]
    assert requests.hold_actions(pulls.limit(0), said).count() == 0


def test_commands_on_requests(spark):
    from sievewright.functions import keys
    from sievewright.operators import requests

    pulls = spark.createDataFrame([(1, "a"), (2, "b/c")], "pull long, key string").select("pull", keys.removal_branch(F.col("key")).alias("branch")).union(spark.createDataFrame([(3, "main")], "pull long, branch string"))
    said = spark.createDataFrame(
        [(1, 1, "write", f"{archive.COMMAND_PREFIX} rerun"), (2, 2, "admin", f"{archive.COMMAND_PREFIX} Recreate"), (3, 1, "read", f"{archive.COMMAND_PREFIX} rerun"), (4, 1, None, f"{archive.COMMAND_PREFIX} rerun"), (5, 1, "write", "thanks"), (6, 3, "write", f"{archive.COMMAND_PREFIX} rerun"), (7, 9, "write", None)],
        "comment_id long, pull long, permission string, body string",
    )
    found = requests.commanded(said, pulls)
    assert [(r.comment_id, r.action) for r in found.orderBy("comment_id").collect()] == [(1, "rerun"), (2, "recreate"), (3, "not-permitted"), (4, "not-permitted"), (5, "not-a-command"), (6, "not-a-removal"), (7, "not-a-pull-request")]
    assert rows(requests.asked(spark.createDataFrame([("a",), ("b/c",), ("z",)], "key string"), found)) == [("a",), ("b/c",)]


def history(n, seed, order=True):
    """Commits on a main line, with side branches that are merged back, and branches off those."""
    import random

    rnd, parents, main = random.Random(seed), {0: []}, [0]
    for k in range(1, n):
        if rnd.random() < 0.6 or len(main) < 3:
            side = [x for x in range(max(0, k - 12), k) if x not in main[-40:]]
            parents[k] = [main[-1], *([rnd.choice(side)] if side and rnd.random() < 0.5 else [])]
            main.append(k)
        else:
            parents[k] = [rnd.randrange(max(0, k - 20), k)]
    return parents


@pytest.mark.parametrize(("n", "places"), [(1, True), (60, True), (60, False), (1500, True)])
def test_ancestry_goes_from_chain_to_chain(spark, monkeypatch, n, places):
    parents = history(n, n)
    rows = [(f"c{k}", f"c{p}", i) for k, ps in parents.items() for i, p in enumerate(ps or [None])]
    rows = [(a, None if b == "cNone" else b, i) for a, b, i in rows]
    commits = spark.createDataFrame(rows, "sha string, parent string, place int")
    tips = [n - 1, n // 2]
    want = set()
    for t in tips:
        seen, todo = set(), [t]
        while todo:
            todo += [p for p in parents[todo.pop()] if p not in seen and not seen.add(p)]
        want |= {(f"c{t}", f"c{x}") for x in seen}
    cuts, cut = [], archive._cut
    monkeypatch.setattr(archive, "_cut", lambda s, df: cuts.append(1) or cut(s, df))
    got = archive.ancestry(commits if places else commits.drop("place"), spark.createDataFrame([(f"c{t}",) for t in tips], "sha string"))
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    assert not places or len(cuts) <= 24


def test_a_history_that_goes_round(spark):
    commits = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "sha string, parent string")
    with pytest.raises(ValueError, match="round"):
        archive.chains(commits)
