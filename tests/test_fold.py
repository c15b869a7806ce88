import pytest

from sievewright import model
from sievewright.functions.scanner import Unreadable
from sievewright.plans import remove
from sievewright.plans.fold import Refused, fold, refusal
from sievewright.sources.config import accessors

READS = accessors("isEnabled, at[1], opt{key}, !off")[0]


@pytest.mark.parametrize(
    ("before", "on", "off"),
    [
        ('if (isEnabled("k")) {\n  a();\n} else {\n  b();\n}\n', "a();\n", "b();\n"),
        ('x = isEnabled("k") ? a(1, 2) : b;', "x = a(1, 2);", "x = b;"),
        ('if (isEnabled("k") && y) { a(); }', "if (y) { a(); }", ""),
        ('if (y && isEnabled("k")) { a(); }', "if (y) { a(); }", ""),
        ('if (f() && isEnabled("k")) { a(); }', "if (f()) { a(); }", "if (f() && false) { a(); }"),
        ('if (!isEnabled("k") || y) { a(); }', "if (y) { a(); }", " a();"),
        ('if (c) { a(); } else if (isEnabled("k")) { b(); } else { d(); }', "if (c) { a(); } else { b(); }", "if (c) { a(); } else { d(); }"),
        ('const v = isEnabled("k");\nf(v, { v: 1 }, o.v);\n', None, None),
        ('const v = isEnabled("k");\nf(v, o.v);\n', "f(true, o.v);\n", "f(false, o.v);\n"),
        ('f(client?.isEnabled("k"));', 'f(client?.isEnabled("k"));', 'f(client?.isEnabled("k"));'),
        ('f(at(ctx, "k"), at("k", ctx));', 'f(true, at("k", ctx));', 'f(false, at("k", ctx));'),
        ('f(opt({ key: "k" }), opt({ other: "k" }));', 'f(true, opt({ other: "k" }));', 'f(false, opt({ other: "k" }));'),
        ('f(off("k"));', "f(false);", "f(true);"),
        ('f(await client.flags.isEnabled("k"));', "f(true);", "f(false);"),
        ('f(isEnabled("k2"), isEnabled(k), "k");', 'f(isEnabled("k2"), isEnabled(k), "k");', 'f(isEnabled("k2"), isEnabled(k), "k");'),
        ('if (isEnabled("k") === false) { a(); }', "", " a();"),
        ('function g() {\n  if (isEnabled("k")) {\n    return 1;\n  }\n  return 2;\n}', "function g() {\n  return 1;\n}", "function g() {\n  return 2;\n}"),
        ('if (isEnabled("k")) { const q = 1; f(q); }', "{ const q = 1; f(q); }", ""),
    ],
)
def test_folds(before, on, off):
    for value, want in ((True, on), (False, off)):
        got = fold(before, "k", value, READS).after
        if want is not None:
            assert got.strip() == want.strip()
        assert refusal(before, got) is None


def test_imports_go_with_their_last_use():
    before = 'import { isEnabled, keep } from "f";\nimport { old } from "o";\nif (isEnabled("k")) { keep(); } else { old(); }\n'
    assert fold(before, "k", True, READS).after == 'import { keep } from "f";\nkeep();\n'


@pytest.mark.parametrize("bad", ['isEnabled("k").value', 'make().isEnabled("k")', 'isEnabled("k")["x"]'])
def test_refusals(bad):
    with pytest.raises(Refused):
        fold(f"f({bad});", "k", True, READS)


def test_shadowed_constants_stay():
    before = 'const v = isEnabled("k");\nfunction g() { const v = 2; return v; }\n'
    assert "const v = true;" in fold(before, "k", True, READS).after
    assert "v = true" in fold('let v = isEnabled("k");\nv = other();\n', "k", True, READS).after


def test_unreadable_and_unknown_languages():
    with pytest.raises(Unreadable):
        fold('if (isEnabled("k")) {', "k", True, READS)
    with pytest.raises(Refused):
        fold("x", "k", True, READS, "ruby")


def test_gate_on_text():
    assert refusal("a b", "ab").startswith("fused")
    assert refusal("(a)", "(a").startswith("the rewrite does not scan")


def test_run(spark):
    c = spark.createDataFrame([("ok", "r", True, "Dead", [], 0), ("bad", "r", False, "Dead", [], 1), ("none", "r", True, "Dead", [], 2), ("held", "r", True, "Dead", ["x"], 3), ("ok", "r", True, "Dead", [], 4)], model.CANDIDATES)
    files = spark.createDataFrame(
        [("a.ts", 'if (isEnabled("ok")) {\n  a();\n}\n'), ("b.ts", "// ok stays. As does this.\nx();\n"), ("c.ts", 'f(isEnabled("bad").v);\n'), ("d.ts", 'if (isEnabled("bad")) { q(); }\n'), ("n.md", "ok"), ("u.ts", None)],
        "path string, content string",
    )
    out = remove.run(c, files, READS)
    got = {r.seq: r for r in out["results"].collect()}
    assert [got[i].action for i in range(5)] == ["dry-run", "unsafe-rewrite", "dry-run", "blocked", "duplicate"]
    assert "-if (isEnabled" in got[0].diff and "+a();" in got[0].diff and not got[2].diff
    assert got[0].unprocessed_files == ["n.md"] and got[0].kept_comments[0].line == 1
    assert got[1].refused_files == ["c.ts"] and got[4].unprocessed_files is None
    assert [(r.flag, r.path) for r in out["rewrites"].collect()] == [("ok", "a.ts")]
    assert {r.seq for r in remove.run(c, files, READS, max_prs=1)["results"].collect()} == {0}


def test_undo_check(spark):
    a = spark.createDataFrame([("x", b"1"), ("y", b"2")], "path string, content binary")
    b = spark.createDataFrame([("x", b"1"), ("z", b"2")], "path string, content binary")
    assert sorted(r.path for r in remove.restored(a, b).collect()) == ["y", "z"]
    assert remove.restored(a, a).count() == 0


PY = accessors("is_on, !is_off, variant{flag}")[0]


@pytest.mark.parametrize(
    ("before", "on", "off"),
    [
        ('if is_on("k"):\n    a()\nelse:\n    b()\nc()\n', "a()\nc()\n", "b()\nc()\n"),
        ('def f():\n    if client.is_on("k") and x:\n        return 1\n    return 2\n', "def f():\n    if x:\n        return 1\n    return 2\n", "def f():\n    return 2\n"),
        ('if x:\n    a()\nelif is_on("k"):\n    b()\nelse:\n    c()\n', "if x:\n    a()\nelse:\n    b()\n", "if x:\n    a()\nelse:\n    c()\n"),
        ('if is_on("k"):\n    a()\nelif x:\n    b()\n', "a()\n", "if x:\n    b()\n"),
        ('y = 1 if not is_on("k") else 2\n', "y = 2\n", "y = 1\n"),
        ('f(is_off("k"), variant(flag="k"), is_on("k2"))\n', 'f(False, True, is_on("k2"))\n', 'f(True, False, is_on("k2"))\n'),
        ('if is_on("k"):\n    s = """\n    kept\n"""\n', 's = """\n    kept\n"""\n', ""),
        ('z = x or is_on("k") or y\n', None, "z = x or y\n"),
    ],
)
def test_python_folds(before, on, off):
    from sievewright.plans.python_fold import fold as python

    for value, want in ((True, on), (False, off)):
        if want is not None:
            assert python(before, "k", value, PY).after == want


def test_python_refusals():
    from sievewright.plans.python_fold import fold as python

    with pytest.raises(Refused):
        python('x = is_on("k").value\n', "k", True, PY)
    with pytest.raises(SyntaxError):
        python("if (", "k", True, PY)


def test_wrappers_and_gates(spark):
    from sievewright.plans import wrappers
    from sievewright.sources.config import Gate

    src = 'class A { isNew(): boolean { return !this.c.isEnabled("k"); } other() { return isEnabled("k") && x; } }\nfunction on() { return isEnabled("k"); }\n'
    assert wrappers.discover(src, "k", READS) == [("isNew", True), ("on", False)]
    df = spark.createDataFrame([("a.ts", src), ("b.ts", None)], "path string, content string")
    assert wrappers.wrappers(df, "k", READS).count() == 2
    gates = [Gate("Gate", "flag")]
    page = '<p><Gate flag="k"><b>x</b></Gate><Gate flag="z"><i/></Gate><Gate flag={"k"}/></p>'
    assert wrappers.unwrap_gates(page, "k", True, gates) == ('<p><b>x</b><Gate flag="z"><i/></Gate></p>', 2)
    assert wrappers.unwrap_gates(page, "k", False, gates) == ('<p><Gate flag="z"><i/></Gate></p>', 2)
    assert wrappers.without_calls("log(1);\nx(log(2));\nlog(f());\n", ["log"]) == ("\nx(log(2));\nlog(f());\n", ["log"])
    calls = spark.createDataFrame([("a", "f", 10)], "path string, name string, line int")
    notes = spark.createDataFrame([("a", 9, "near"), ("a", 7, "far"), ("b", 10, "other")], "path string, line int, text string")
    assert [r.text for r in wrappers.comments_at_calls(calls, notes).collect()] == ["near"]


def test_sinks(spark, tmp_path):
    import subprocess

    from sievewright.operators import sinks

    subprocess.run(["git", "init", "-q", "-b", "main", str(tmp_path)], check=True)
    for k in ("user.name", "user.email"):
        subprocess.run(["git", "-C", str(tmp_path), "config", k, "x"], check=True)
    (tmp_path / "a.ts").write_text("1")
    (tmp_path / "b.ts").write_text("2")
    rows = spark.createDataFrame([("a.ts", "1", "3"), ("b.ts", "2", None)], "path string, before string, after string")
    subprocess.run(["git", "-C", str(tmp_path), "add", "."], check=True)
    subprocess.run(["git", "-C", str(tmp_path), "commit", "-qm", "x"], check=True)
    paths = sinks.apply(rows, str(tmp_path))
    assert (tmp_path / "a.ts").read_text() == "3" and not (tmp_path / "b.ts").exists()
    assert len(sinks.commit(str(tmp_path), paths, "remove", "gone")) == 40
    remote = tmp_path / "remote.git"
    subprocess.run(["git", "init", "-q", "--bare", str(remote)], check=True)
    assert sinks.push(str(tmp_path), str(remote), "gone")
    subprocess.run(["git", "-C", str(tmp_path), "commit", "-q", "--amend", "-m", "again"], check=True)
    assert not sinks.push(str(tmp_path), str(remote), "gone", "1" * 40) and not sinks.push(str(tmp_path), str(remote), "gone")
    with pytest.raises((RuntimeError, FileNotFoundError)):
        sinks.apply(rows, str(tmp_path))
    sent = []
    r = sinks.Reporter(lambda k, u: sent.append(k) or ("forbidden" if k == "b" else "linked"))
    assert [r.report("a", "u"), r.report("x", None), r.report("b", "u"), r.report("c", "u")] == ["linked", "nothing", "forbidden", "stopped"]


def test_a_run_with_gates_and_calls_without_effects(spark):
    from sievewright.sources.config import Gate

    c = spark.createDataFrame([("k", "r", True, "Dead", [], 0), ("z", "r", False, "Dead", [], 1)], model.CANDIDATES)
    files = spark.createDataFrame(
        [("a.tsx", 'const A = () => <p><Gate flag="k"><b>x</b></Gate></p>;\n'), ("b.tsx", 'const B = () => <Gate flag="z"><i>y</i></Gate>;\n'), ("c.ts", 'track("old");\nif (isEnabled("k")) {\n  a();\n}\nlog(isEnabled("k"));\nif (q)\n  log(isEnabled("k"));\n')],
        "path string, content string",
    )
    out = remove.run(c, files, READS, gates=[Gate("Gate", "flag")], inert=["log", "track"])
    got = {r.path: r.after for r in out["rewrites"].collect()}
    assert got["a.tsx"] == "const A = () => <p><b>x</b></p>;\n" and got["b.tsx"] == "const B = () => null;\n"
    assert got["c.ts"] == 'track("old");\na();\nif (q)\n  log(true);\n'
    assert [(r.path, r.kind, r.reason) for r in out["findings"].collect()] == [("c.ts", "call-removed", "log")]
