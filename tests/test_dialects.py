"""Folds of Go, Kotlin and Swift."""

import random
import re

import pytest

from sievewright.functions import comments
from sievewright.functions.scanner import Unreadable, scan, text
from sievewright.plans.fold import Refused, fold, refusal
from sievewright.sources.config import accessors

READS = accessors("isEnabled, IsOn")[0]
CASES = [
    ("go", 'import (\n\t"fmt"\n\t"x/flags"\n)\n\nfunc f(ctx C) int {\n\tif flags.IsOn("k") && ctx.ok {\n\t\tfmt.Println(1)\n\t\treturn 1\n\t} else {\n\t\treturn 2\n\t}\n}\n', 'import (\n\t"fmt"\n)\n\nfunc f(ctx C) int {\n\tif ctx.ok {\n\t\tfmt.Println(1)\n\t\treturn 1\n\t} else {\n\t\treturn 2\n\t}\n}\n', None),
    ("go", 'func f() int {\n\ton := isEnabled("k")\n\tif !on {\n\t\treturn 1\n\t}\n\treturn 2\n}\n', "func f() int {\n\treturn 2\n}\n", "func f() int {\n\treturn 1\n}\n"),
    ("go", 'func f() {\n\tfor isEnabled("k") {\n\t\tx(`\\`, \'\\\'\')\n\t}\n}\n', "func f() {\n\tfor {\n\t\tx(`\\`, '\\'')\n\t}\n}\n", "func f() {\n}\n"),
    ("go", 'func f() {\n\tv := isEnabled("k") && eq(x, T{A: 1})\n\tg(v)\n}\n', "func f() {\n\tv := eq(x, T{A: 1})\n\tg(v)\n}\n", "func f() {\n\tg(false)\n}\n"),
    ("go", 'func f() {\n\tif isEnabled("k") {\n\t\tx := 1\n\t\tg(x)\n\t}\n\tx := 2\n\tg(x)\n}\n', "func f() {\n\t{\n\t\tx := 1\n\t\tg(x)\n\t}\n\tx := 2\n\tg(x)\n}\n", "func f() {\n\tx := 2\n\tg(x)\n}\n"),
    ("go", 'func f() {\n\tif on := c.IsOn("k"); on && x {\n\t\ta(on)\n\t} else {\n\t\tb()\n\t}\n}\n', "func f() {\n\tif x {\n\t\ta(true)\n\t} else {\n\t\tb()\n\t}\n}\n", "func f() {\n\tb()\n}\n"),
    ("go", 'func f() {\n\tif on := IsOn("k"); x {\n\t\ton = y\n\t\ta(on)\n\t}\n}\n', "func f() {\n\tif on := true; x {\n\t\ton = y\n\t\ta(on)\n\t}\n}\n", None),
    ("kt", 'val r = q.let { if (isEnabled("k")) a() else b() }\n', "val r = q.let { a() }\n", "val r = q.let { b() }\n"),
    ("kt", 'fun f(): Int {\n    val on = flags.isEnabled("k")\n    if (on) {\n        return 1\n    }\n    return 2\n}\n', "fun f(): Int {\n    return 1\n}\n", "fun f(): Int {\n    return 2\n}\n"),
    ("kt", 'val s = if (isEnabled("k")) "a ${g("x")}" else "b"\nfun g() = if (isEnabled("k")) { 1 } else 2\n', 'val s = "a ${g("x")}"\nfun g() = 1\n', 'val s = "b"\nfun g() = 2\n'),
    ("kt", 'class A {\n    val on = isEnabled("k")\n    fun x() = f(c?.isEnabled("k") ?: false, isEnabled("k") ?: true)\n}\n', 'class A {\n    val on = true\n    fun x() = f(c?.isEnabled("k") ?: false, true)\n}\n', None),
    ("kt", 'fun f() {\n    if (isEnabled(key = "k") || y) a() else b()\n    c()\n}\n', "fun f() {\n    a()\n    c()\n}\n", "fun f() {\n    if (y) a() else b()\n    c()\n}\n"),
    ("kt", 'val r = run {\n    a()\n    if (isEnabled("k")) b()\n}\n', "val r = run {\n    a()\n    if (true) b()\n}\n", None),
    ("kt", 'fun f() {\n    val on = isEnabled("k")\n    log("on is $on")\n}\n', 'fun f() {\n    val on = true\n    log("on is $on")\n}\n', None),
    ("swift", 'func f() -> Int {\n    guard isEnabled("k") else {\n        return 1\n    }\n    return 2\n}\n', "func f() -> Int {\n    return 2\n}\n", "func f() -> Int {\n    return 1\n}\n"),
    ("swift", 'func f() {\n    if let x = y, flags.isEnabled("k") {\n        a("\\(g("q"))")\n    } else if isEnabled("k"), z {\n        b()\n    } else {\n        c()\n    }\n}\n', 'func f() {\n    if let x = y {\n        a("\\(g("q"))")\n    } else if z {\n        b()\n    } else {\n        c()\n    }\n}\n', None),
    ("swift", 'func f() {\n    let on = isEnabled("k")\n    g(on: on, x: on ? 1 : 2)\n}\n', "func f() {\n    g(on: true, x: 1)\n}\n", "func f() {\n    g(on: false, x: 2)\n}\n"),
    ("swift", 'func f() {\n    x = try isEnabled("k") ?? false\n    let ys = xs.filter { isEnabled("k") && $0.ok }\n    h(#"a "b" c"#)\n}\n', 'func f() {\n    x = true\n    let ys = xs.filter { $0.ok }\n    h(#"a "b" c"#)\n}\n', None),
]


@pytest.mark.parametrize(("language", "before", "on", "off"), CASES)
def test_folds(language, before, on, off):
    assert text(*scan(before, language=language)) == before
    for value, want in ((True, on), (False, off)):
        if want is not None:
            got = fold(before, "k", value, READS, language).after
            assert got == want and refusal(before, got, language) is None


@pytest.mark.parametrize(
    ("language", "before"),
    [
        ("go", 'func f() (bool, error) {\n\treturn isEnabled("k")\n}\n'),
        ("go", 'func f() {\n\tv, err := isEnabled("k")\n\tg(v, err)\n}\n'),
        ("go", 'func f() {\n\tc := mk()\n\tif c.isEnabled("k") {\n\t\tg()\n\t}\n}\n'),
        ("kt", 'fun f() {\n    if (isEnabled("k")) {\n        val y = 2\n        c(y)\n    }\n    val y = 3\n}\n'),
        ("kt", 'val x = isEnabled("k")!!\n'),
        ("swift", 'let x = try? isEnabled("k")\n'),
        ("swift", 'let x = isEnabled("k") { $0 }\n'),
    ],
)
def test_refusals(language, before):
    with pytest.raises(Refused):
        fold(before, "k", True, READS, language)


@pytest.mark.parametrize(("language", "source"), [("kt", "/* a /* b */ c */ f()"), ("swift", '"a \\(b'), ("kt", '"a\n"'), ("go", "`a")])
def test_unreadable(language, source):
    with pytest.raises(Unreadable):
        scan(source, language=language)


def test_damaged_sources_are_refused_or_fold_to_sources():
    """Sources with pieces taken out, doubled or swapped never end in another error, and what is accepted scans."""
    rng, folded = random.Random(7), 0
    shapes = [*((x, b) for x, b, _, _ in CASES), ("ts", 'const on = isEnabled("k") ? a : b; if (x && isEnabled("k")) { f(); } else if (on) g(); for (;;) if (isEnabled("k")) h();\n')]
    for _ in range(6000):
        language, source = rng.choice(shapes)
        pieces = re.findall(r'isEnabled\("k"\)|\s+|\w+|"[^"\n]*"|.', source)
        for _ in range(rng.randint(1, 3)):
            a, b = rng.randrange(len(pieces)), rng.randrange(len(pieces))
            change = rng.randrange(3)
            if change == 0 and len(pieces) > 1:
                del pieces[a]
            elif change == 1:
                pieces.insert(a, pieces[b])
            else:
                pieces[a], pieces[b] = pieces[b], pieces[a]
            if not pieces:
                break
        try:
            got = fold("".join(pieces), "k", rng.random() < 0.5, READS, language)
        except (Refused, Unreadable):
            continue
        scan(got.after, language=language)
        folded += got.reads > 0
    assert folded > 500


def test_comments_by_dialect():
    assert comments.only_in_comments("x := `//` // my-flag\n", "my-flag", "go") is True
    assert comments.only_in_comments('val x = "${"//"} my-flag"', "my-flag", "kt") is False
    assert comments.tidy("// my-flag is on.\nx := `\\`\n", "my-flag", False, "go") == "x := `\\`\n"
