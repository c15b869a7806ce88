"""Counts of syntax errors, the gate on them, reachability, and conditionals nested at random."""

import random
import re

import pytest
from sievewright.functions.grammar import count_errors
from sievewright.plans import reach
from sievewright.plans.fold import MARKUP, Refused, fold, refusal
from sievewright.functions.scanner import scan
from sievewright.plans import python_fold
from sievewright.sources.config import accessors

READS = accessors("isEnabled")[0]

#: Sources without errors.
RIGHT = [
    ('ts', 'const x = a ? b : c ? d : e;'),
    ('ts', 'const f = (x: number, y?: string): Foo<Bar> => ({ a: 1, b, ...c });'),
    ('ts', 'function f<T>(a: T, b = 2): void { if (a) { return; } else if (b) g(); else { h(); } }'),
    ('ts', 'export class A extends B implements C { private readonly x: number = 1; static y?: string; constructor(private a: X) { super(); } get z() { return this.x; } async *m(): Promise<void> { for await (const q of r()) { yield q; } } }'),
    ('ts', "switch (x) { case 1: a(); break; case 'b': { c(); } default: d(); }"),
    ('ts', 'label: for (let i = 0; i < 3; i++) { continue label; }'),
    ('ts', 'try { a(); } catch (e) { b(); } finally { c(); }'),
    ('ts', 'do { a(); } while (b);'),
    ('ts', "import { a, b as c } from 'x';\nimport d from 'y';\nexport default function () { return 1 }"),
    ('ts', 'const { a, b: c = 1 } = d, [e, , f] = g;'),
    ('ts', 'type X = { a: string; b?: number } | null;\ninterface Y { a(b: string): void; c: number }'),
    ('ts', 'x ??= y || z;\na?.b?.(c)?.[d]!.e;'),
    ('ts', 'const t = tag`a${b}`; if (!a) return; else return b;'),
    ('ts', 'let x = a as unknown as B;\nfor (;;) {}\nwhile (true) { break; }'),
    ('ts', "const o = { 'a-b': 1, [c]: 2, d() { return 1; }, get e() { return 2; }, async f() {} };"),
    ('ts', "enum E { A = 1, B }\ndeclare module 'x' { }"),
    ('ts', 'let a = b\nlet c = d\n;[1, 2].forEach(x => x)'),
    ('ts', 'if (a) b\nelse c'),
    ('ts', 'const f = async function* () { };\nnew Foo<Bar>(a, b).c();\nreturn a < b && c > d;'),
    ('ts', 'f(a, function () { return 1; }, b => c, (d, e) => { });'),
    ('ts', 'const x = <T,>(a: T) => a;\nconst y = a! + b!;'),
    ('tsx', 'const a = <div className="x" on={() => f(1)}>{a ? <b/> : null} text {...c}</div>;'),
    ('tsx', 'return (<><A {...p} b={c && d}/>{xs.map(x => <li key={x}>{x}</li>)}</>);'),
    ('java', 'public class A<T extends B> extends C implements D, E { private final Map<String, List<Integer>> x = new HashMap<>(); @Override public int f(final String a, int... b) throws X { for (int i = 0; i < 3; i++) { a(); } for (String s : xs) b(s); return a ? (int) b : c; } }'),
    ('java', 'try (A a = new A()) { b(); } catch (X | Y e) { throw new Z(e); }'),
    ('java', 'Runnable r = () -> { a(); }; Function<A, B> f = x -> x.y(); g(A::b);'),
    ('java', 'switch (x) { case 1: a(); break; default: b(); }'),
    ('java', 'int y = switch (x) { case 1 -> 2; default -> 3; };'),
    ('java', 'List<? extends A> a = b; int[] c = new int[] {1, 2}; A d = new A() { void f() { } };'),
    ('csharp', 'namespace A.B { public class C : D, IE { public int X { get; set; } = 1; public async Task<int> F(string a, int? b = null) => await G(a: a, b: b); int this[int i] => x[i]; } }'),
    ('csharp', 'var x = a ?? b; var y = c is null ? d : e; foreach (var z in q) { w(z); } using (var s = t()) { }'),
    ('csharp', 'var q = new Foo { A = 1, B = 2 }; Func<int, int> f = x => x + 1; if (a is Foo b && b.C) return; var z = a?.b?[0];'),
    ('csharp', 'var r = x switch { 1 => 2, _ => 3 }; int? n = null; lock (a) { b(); }'),
    ('dart', 'class A extends B { final int? x; A({required this.x, Key? key}) : super(key: key); Widget build(BuildContext c) { return Foo(a: 1, b: [if (x) y, for (var z in q) z, ...w], c: () => d); } }'),
    ('dart', "final f = (int a) => a ? b : c; var s = 'a' 'b'; x?.y ?? z; a..b()..c(); Map<String, int> m = {'a': 1};"),
    ('dart', 'try { a(); } on X catch (e) { b(); } catch (e, s) { c(); }'),
    ('go', 'package a\n\nimport (\n\t"b"\n)\n\nfunc (s *S) F(a int, b ...string) (int, error) {\n\tif x, err := f(); err != nil {\n\t\treturn 0, err\n\t} else if y {\n\t\tz()\n\t}\n\tfor i := 0; i < 3; i++ {\n\t\ta[i] = b[1:2]\n\t}\n\tfor k, v := range m {\n\t\tg(k, v)\n\t}\n\tswitch x {\n\tcase 1, 2:\n\t\ta()\n\tdefault:\n\t\tb()\n\t}\n\tgo func() { c() }()\n\tdefer d()\n\tx := T{A: 1, B: []int{1, 2}}\n\ts := &x\n\tch <- 1\n\treturn map[string]int{"a": 1}, nil\n}\ntype T struct {\n\tA int `json:"a"`\n\tB []int\n}\nvar e = 1\n'),
    ('kt', 'package a.b\n\nimport c.d\n\nclass A(private val x: Int, y: String = "a") : B(x), C by d {\n    val z: Int by lazy { 1 }\n    override fun f(a: Int?): List<Int> = when (a) {\n        null -> emptyList()\n        in 1..2, 3 -> listOf(1)\n        is Int -> g { it + 1 }\n        else -> { h() }\n    }\n    fun i() {\n        val (q, r) = a to b\n        if (a) b() else c()\n        val s = if (a) 1 else 2\n        for (x in y) { z() }\n        xs.map { x -> x.y }.filter { it }\n        do { a() } while (b)\n        try { a() } catch (e: X) { b() } finally { c() }\n        return x ?: y!!.z\n    }\n    companion object { const val K = 1 }\n}\n'),
    ("swift", 'import A\n\nclass B: C, D {\n    let x: Int?\n    var y: [String: Int] = [:]\n    init(x: Int, _ y: String = "a") throws {\n        self.x = x\n        super.init()\n    }\n    func f<T>(a b: T) -> Int {\n        guard let z = x, z > 0 else { return 1 }\n        if let q = w, case .a(let r) = q { s() } else if t { u() } else { v() }\n        for i in 0..<3 where i > 1 { g(i) }\n        switch z {\n        case 1, 2:\n            a()\n        case .b(let c) where c:\n            d()\n        default:\n            break\n        }\n        xs.map { $0 + 1 }.filter { x in x > 1 }\n        do { try h() } catch { i() }\n        let k = a ? b : c\n        let m = try? n() ?? o\n        repeat { a() } while b\n        return x!\n    }\n    var p: Int { return 1 }\n}\n'),
]

#: Sources with one error or more.
WRONG = [
    ('ts', 'const x = a : d;'),
    ('ts', 'return a : d;'),
    ('ts', 'f(a : d);'),
    ('ts', 'const x = ;'),
    ('ts', 'const x = a && ;'),
    ('ts', 'if () { a(); }'),
    ('ts', 'if (a)'),
    ('ts', 'else { b(); }'),
    ('ts', 'a ? b;'),
    ('ts', 'const x = (a ? b);'),
    ('ts', 'x = || y;'),
    ('ts', 'f(, a) + ;'),
    ('ts', 'while () a();'),
    ('ts', 'const x = 1 2;'),
    ('ts', 'const x = true false;'),
    ('ts', 'do { a(); }'),
    ('ts', 'try { a(); }'),
    ('ts', 'const f = () => ;'),
    ('ts', 'x = a ? : b;'),
    ('ts', 'return !;'),
    ('ts', 'a = b ? c : ;'),
    ('ts', 'for (const x of xs)'),
    ('ts', 'const x = [a ? b];'),
    ('ts', 'const o = { a: b : c };'),
    ('ts', 'x = a. ;'),
    ('ts', 'true(1) 2;'),
    ('ts', 'f(a ? b);'),
    ('tsx', 'return <div>{a : b}</div>;'),
    ('tsx', 'return <div a={b ? c}/>;'),
    ('java', 'int x = a : d;'),
    ('java', 'return a : d;'),
    ('java', 'if () { a(); }'),
    ('java', 'f(a : b);'),
    ('csharp', 'var x = a : d;'),
    ('csharp', 'return a ? b;'),
    ('dart', 'final x = a : d;'),
    ('dart', 'var x = [a ? b];'),
    ('go', 'func f() {\n\tif {\n\t\ta()\n\t}\n}'),
    ('go', 'x := a +\n'),
    ('go', 'func f() {\n\tx = \n}'),
    ('kt', 'val x = \n'),
    ('kt', 'fun f() { if () a() }'),
    ('kt', 'val x = a +'),
    ('kt', 'fun f() { else { a() } }'),
    ('swift', 'let x = a : d'),
    ('swift', 'if { a() }'),
    ('swift', 'let x = a ? b'),
    ('swift', 'guard a { return }'),
]


@pytest.mark.parametrize(("language", "source"), RIGHT)
def test_no_errors(language, source):
    assert count_errors(source, language, language in MARKUP) == 0


@pytest.mark.parametrize(("language", "source"), WRONG)
def test_errors(language, source):
    assert count_errors(source, language, language in MARKUP) > 0
    assert refusal(source, source, language) is None  # what was wrong before is no fault of a rewrite


def test_reading_goes_on_after_an_error():
    assert count_errors("const x = 1 2; f(a : b); if () {} y();", "ts") == 3


def tree(rnd, depth, flags):
    if not depth or rnd.random() < 0.2:
        return rnd.choice("abcdefg")
    test = rnd.choice(["p", "q", "r", *flags])
    return test, tree(rnd, depth - 1, flags), tree(rnd, depth - 1, flags)


def shown(t, rnd, inner=False):
    if isinstance(t, str):
        return t
    test = f"isEnabled('{t[0]}')" if len(t[0]) > 1 else t[0]
    if rnd.random() < 0.2:
        test, t = f"!{test}", (t[0], t[2], t[1])
    text = f"{test} ? {shown(t[1], rnd, True)} : {shown(t[2], rnd)}"
    return f"({text})" if rnd.random() < 0.3 else text


def settled(t, value):
    if isinstance(t, str):
        return t
    if t[0] == "k1":
        return settled(t[1 if value else 2], value)
    return t[0], settled(t[1], value), settled(t[2], value)


def read(text):
    """The tree of a conditional's text."""
    tokens = re.findall(r"isEnabled\('\w+'\)|\w+|[?:()!]", text)
    at = 0

    def operand():
        nonlocal at
        x = tokens[at]
        at += 1
        if x == "!":
            return "!" + operand()
        if x == "(":
            out = whole()
            at += 1
            return out
        return x

    def whole():
        nonlocal at
        test = operand()
        if at == len(tokens) or tokens[at] != "?":
            return test
        at += 1
        a = whole()
        at += 1
        b = whole()
        name = re.sub(r"isEnabled\('(\w+)'\)", r"\1", test)
        return (name[1:], b, a) if name[0] == "!" else (name, a, b)

    out = whole()
    assert at == len(tokens), text
    return out


@pytest.mark.parametrize(("language", "head"), [("ts", "const x = "), ("java", "return "), ("csharp", "f("), ("dart", "final x = "), ("swift", "let x = "), ("js", "x => "), ("tsx", "[z, ")])
def test_conditionals_nested_at_random(language, head):
    rnd = random.Random(language)
    tail = {"f(": ");", "[z, ": "];"}.get(head, "\n" if language == "swift" else ";")
    folded = 0
    for _ in range(300):
        t = tree(rnd, 3, ["k1", "k2"])
        text = shown(t, rnd)
        source = head + (text if language != "swift" else text.replace("'", '"')) + tail
        for value in (True, False):
            out = fold(source, "k1", value, READS, language)
            folded += out.reads > 0
            assert refusal(source, out.after, language) is None, (source, out.after)
            assert read(out.after[len(head) : -len(tail)].replace('"', "'")) == settled(t, value), (source, value, out.after)
    assert folded > 150


@pytest.mark.parametrize(
    ("language", "source", "dead"),
    [
        ("ts", "function f() { return 1; a(); }", ["a ( ) ;"]), ("ts", "for (;;) { if (x) break; } a();", []), ("ts", "while (true) { b(); } a();", ["a ( ) ;"]), ("ts", "l: while (true) { for (;;) { break l; } } a();", []), ("ts", "l: { break l; } a();", []),
        ("ts", "while (true) { switch (x) { case 1: break; } } a();", ["a ( ) ;"]), ("ts", "try { return 1; } catch (e) { b(); } a();", []), ("ts", "try { return 1; } finally { b(); } a();", ["a ( ) ;"]), ("ts", "if (a) { return; } else { throw b; } c();", ["c ( ) ;"]), ("ts", "if (a) return; c();", []),
        ("ts", "do { a(); } while (true); b();", ["b ( ) ;"]), ("java", "class A { int f() { while (true) { g(); } } int h() { return 1; } }", []), ("ts", "const f = () => { return 1; b(); }; c();", ["b ( ) ;"]), ("ts", "return\nf()", []), ("go", "func f() { return; a() }", []),
        ("ts", "switch (x) { case 1: return a; b(); default: c(); }", ["b ( ) ;"]), ("ts", "while (true) { continue; a(); }", ["a ( ) ;"]), ("ts", "xs.forEach(x => { if (x) { return; } y(); }); z();", []),
    ],
)
def test_what_is_reached(language, source, dead):
    tokens, _ = scan(source, False, language)
    tokens.language = language
    got = [" ".join(t.text for t in tokens[a:b]) for a, b in reach.unreachable(tokens)]
    assert got == (dead if source != "return\nf()" else ["f ( )"])


def test_results_that_do_not_compile_are_refused():
    for language, source in [("csharp", 'var x = isEnabled("k") ? null : y;'), ("java", 'var x = isEnabled("k") ? null : y;'), ("swift", 'let x = isEnabled("k") ? nil : y\n'), ("go", 'func f() {\nx := nil\ng(isEnabled("k"), x)\n}')]:
        if language == "go":
            assert fold(source, "k", True, READS, language).reads == 1  # it was so before
            continue
        with pytest.raises(Refused):
            fold(source, "k", True, READS, language)
    assert fold('String x = isEnabled("k") ? null : y;', "k", True, READS, "java").after == "String x = null;"


@pytest.mark.parametrize(
    ("source", "value", "after"),
    [
        ('def f():\n    if isEnabled("k"):\n        x = 1\n    else:\n        yield 2\n', True, None), ('def f():\n    if not isEnabled("k"):\n        global G\n    G = 1\n', True, None), ('def f():\n    if not isEnabled("k"):\n        global G\n    return G\n', True, "def f():\n    return G\n"),
        ('if isEnabled("k"): a(); b()  # c\nelse:\n    d()\n', True, "a(); b()  # c\n"), ('if isEnabled("k"): a()\nelse:\n    d()\n', False, "d()\n"), ('x = {a: b for a in c if isEnabled("k") if d}\n', True, "x = {a: b for a in c if d}\n"),
    ],
)
def test_python_shapes(source, value, after):
    if after is None:
        with pytest.raises(Refused):
            python_fold.fold(source, "k", value, READS)
    else:
        assert python_fold.fold(source, "k", value, READS).after == after


def test_python_findings():
    kinds = lambda s: [(line, kind) for line, kind, _ in python_fold.fold(s, "k", False, READS).findings]
    assert kinds('a()\nassert isEnabled("k"), "x"\n') == [(2, "failing-assertion")]
    assert kinds('x = [a for a in b if isEnabled("k")]\n') == [(1, "kept")]
    assert kinds('assert not isEnabled("k")\n') == []


def test_a_result_that_does_not_scan_refuses_the_flag(spark, monkeypatch):
    from sievewright.plans import remove

    rows = spark.createDataFrame([("k", "k", True, "a.ts", "ts", "f(isEnabled('k'"), ("k", "k", True, "b.py", "python", "f(isEnabled('k'"), ("k", "k", True, "c.ts", "ts", "f(isEnabled('k'));")], "flag string, code_key string, treatment boolean, path string, language string, before string")
    got = {r.path: (r.reason, [f.kind for f in r.findings], r.after) for r in remove.folded(rows, READS).collect()}
    assert got == {"a.ts": (None, ["unreadable"], "f(isEnabled('k'"), "b.py": (None, ["unreadable"], "f(isEnabled('k'"), "c.ts": (None, [], "f(true);")}
    assert remove._readable("f(", "ts") is False and remove._readable("f()", "ts") and remove._readable("x = 1", "python")
