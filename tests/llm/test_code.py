import random

import pytest

from factloom.llm import chart, grammars, handwritten, near, syntax

GOOD = {
    "java": [
        "", "package a.b; import static x.Y.*; import z.W; @A(x = {1, 2}, y = \"s\") public final class T<K extends Comparable<K> & B> extends C<D> implements E, F { }",
        "class A { int[] a = {1, 2,}, b[] = new int[3][]; Map<String, List<? extends X>> m = new HashMap<>(); static { x(); } A(int n) { this(n, 1); } abstract int f(final int... q) throws E; @Override public <T> T g() { return null; } }",
        "class A { void f() { if (a) b(); else if (c) { d(); } else e(); for (int i = 0, j = 1; i < 9; i++, j--) ; for (var x : xs) { } do { x++; } while (y); label: while (true) { break label; } } }",
        "class A { void f() { try (var r = o(); s) { } catch (X | Y e) { } finally { } switch (k) { case 1, 2 -> x(); case Q: y(); default -> throw new E(); } int z = switch (k) { case A -> 1; default -> { yield 2; } }; } }",
        "class A { Object o = (Runnable & S) () -> { }; F<A> f = x -> y -> x + y; G g = A::new; H h = int[]::new; boolean b = o instanceof String s && s.length() > 3 ? a < b : c >= d; long q = 0xFFL >>> 2; char c = '\\u0041'; String t = \"\"\"\n hi \\\" \"\"\"; }",
        "sealed interface S permits A, B { } record R<T>(int a, @N T b) implements S { R { if (a < 0) throw new E(); } static int z() { return 1; } } enum E { X(1) { void f() { } }, Y; E() { } int q; } @interface I { int v() default 1; }",
        "class A { void f() { int x = a[1].b(c)[2].d; new B(1) { int y; }.go(); this.<T>h(); synchronized (this) { assert x > 0 : \"m\"; } ; ; x = y = z; i += 2; --i; a.b.c d = null; // }\n /* { */ } }",
    ],
    "js": [
        "", "'use strict'\nlet a = 1, {b, c: [d = 2, ...e]} = f\nvar g\nreturn\n", "function* f(a, {b} = {}, ...c) { yield* a; yield; } async function g() { await h(); for await (const x of y) { } }", "x = a => b => ({c: 1, ['d']: 2, e, f() { }, get g() { return 1 }, set g(v) { }, async *h() { }, ...i})",
        "class A extends B.c { #p = 1; static q; static { x() } constructor() { super() } get z() { return this.#p } static async m() { } 'str'() { } }", "if (a) b\nelse if (c) d; else { e }\nfor (;;) { break }\nfor (const k in o) continue\nlabel: do { } while (x)\nswitch (a) { case 1: b; default: }",
        "`a${b + `c${d}`}e`; x = /[/\\]]+/g.test(y) / 2; tag`t`; a?.b?.[c]?.(d) ?? e; new X; new Y(1).z; !function(){}(); (()=>{})(); void 0; a ? b : c ? d : e; i++\n++j", "try { } catch { } finally { }\nthrow new Error('x')\n;[1,,2].map(x => x ** 2, )\nmodule.exports = {default: 1, class: 2, if() { }}; a.class.default",
    ],
    "py": ["", "x = 1\n", "def f(a, *, b=1, **c) -> int:\n    '''doc'''\n    return a if b else c\n\nclass A(B, metaclass=C):\n    x: int = 1\n    @d\n    async def g(self): await h()\n", "try:\n  pass\nexcept (A, B) as e:\n  raise X from e\nelse:\n  y\nfinally:\n  z\n", "with a as b, c: d; e\nfor i, (j, k) in x:\n\tif i: continue\n\telif j: break\nelse: pass\n", "a, *b = [x for x in y if z], {k: v for k, v in w}, {1, 2}, (t for t in u), lambda q, r=1: q\nx[1:2, ::3] = f'{a}' 'b'\nmatch p:\n    case [1, _]: pass\n    case Q(r=2) | None if s:\n        pass\n"],
    "json": ["{}", "[1, -2.5e+3, \"a\\u00e9\\n\", true, null, {\"a\": [[]]}]", "\"x\"", " 0 "],
    "xml": ["<a/>", "<?xml version=\"1.0\"?>\n<!DOCTYPE m [<!ENTITY x \"y\">]>\n<!-- c --><a b='1' c:d=\"&lt;\"><e>t &amp; &#10;</e><![CDATA[ <x ]]><?p i?></a>\n"],
}
BAD = {
    "java": ["class A {", "class A { void f() { x( } }", "class A { int x = ; }", "class A { void f() { return } }", "class A { void f() { x y z; } }", "class A { void f() { a + b; } }", "class A { void f() { \"s\"; } }", "<<<<<<< HEAD\nclass A { }\n", "class A { String s = \"x; }", "{\"a\": 1}", "class A { int f( { } }", "class A { void f() { if a { } } }", "def f():\n  pass", "class A { void f() { else { } } }", "class A { int x = 1 2; }", "}"],
    "js": ["function f( { }", "let x = ;", "import a from 'b'", "export const a = 1", "if (a { }", "x = {a: 1", "`abc", "let a: number = 1", "class A { x: 1 }", "a b c", "<div/>", "for (let i = 0; i < 3) { }", "var = 3", "}"],
    "py": ["x = (1\n", "def f()\n  pass\n", "if x:\npass\n", "print 'x'\n", "x = = 1\n", "  x\n y\n", "class A { }\n", "'abc\n", "return )\n", "for x y: pass\n"],
    "json": ["", "{a: 1}", "[1,]", "{\"a\": 1,}", "'a'", "01", "[1 2]", "{\"a\" 1}", "nan", "{} {}", "\"a\nb\"", "// c\n1"],
    "xml": ["", "<a>", "<a></b>", "<a b=1/>", "<a/><b/>", "<a>&x y</a>", "text", "<a><![CDATA[ </a>", "<a>]]></a>", " <?xml version='1.0'?><a/>"],
}


@pytest.mark.parametrize("lang,text", [(k, t) for k, v in GOOD.items() for t in v])
def test_valid(lang, text):
    cost, edits = chart.parse(grammars.grammar(lang), grammars.LANGUAGES[lang][2](text))
    assert cost == 0, edits


_MIDDLE = lambda n: "a ? " * n + "b" + " : c" * n
NESTED = {
    "java": [
        "class A { Map<String, Map<String, List<Optional<X>>>> m; }", "class A { " + "L<" * 30 + "X" + ">" * 30 + " m; }", "class A { void f() { do x(); while (c); } }", "class A { void f() { if (a) if (b) x(); else y(); else z(); } }",
        "class A { void f() { if (a) for (;;) if (b) while (c) do x(); while (d); else y(); else if (e) if (f) u(); else v(); else w(); } }", f"class A {{ int x = {_MIDDLE(12)}; }}",
    ],
    "js": ["if (a) for (k in b) c(k); else d();", "if (a) while (b) c(); else d();", "if (a) if (b) c(); else d(); else e()", "if (a)\n  for (;;)\n    if (b)\n      c()\n    else\n      d()\nelse e()", "with (a) b();", f"x = {_MIDDLE(3)};", f"x = {_MIDDLE(12)}\ny = {_MIDDLE(5)}"],
}
BROKEN = {
    "java": ["class A { Map<String, Map<String, List<Optional<X>>> m; }", "class A { void f() { do x(); while (c) } }", "class A { void f() { do x(); y(); while (c); } }", "class A { void f() { if (a) x(); else y(); else z(); } }", f"class A {{ int x = {_MIDDLE(12)} : d; }}"],
    "js": ["if (a) for (k in b) c(k); else d(); else e();", "with a b();", f"x = {_MIDDLE(3)} : d;", "if (a) if (b) c(); d(); else e()"],
}


@pytest.mark.parametrize("lang,text", [(k, t) for k, v in NESTED.items() for t in v])
def test_nesting_of_any_depth_is_valid(lang, text):
    assert syntax.verdict(lang, text) == (0, None, None)


@pytest.mark.parametrize("lang,text", [(k, t) for k, v in BROKEN.items() for t in v])
def test_broken_nesting_is_invalid(lang, text):
    assert syntax.verdict(lang, text)[0] > 0


@pytest.mark.parametrize("lang,text", [(k, t) for k in ("java", "js") for t in GOOD[k] + BAD[k]])
def test_earley_agrees_with_the_automaton(lang, text):
    g, h = grammars.grammar(lang), chart.Grammar(*grammars.LANGUAGES[lang][:2], recursive=True)
    h.exact = lambda rule, content: -1 if h.derives(rule, content) else 0
    tokens = grammars.LANGUAGES[lang][2](text)
    assert (chart.parse(g, tokens)[0] == 0) == (chart.parse(h, tokens)[0] == 0)


@pytest.mark.parametrize("lang,text", [(k, t) for k, v in BAD.items() for t in v])
def test_invalid(lang, text):
    assert syntax.verdict(lang, text)[0] > 0


@pytest.mark.parametrize(
    "lang,text,line",
    [("py", "x = 2\nf() = 1\n", 2), ("py", "1 = x\n", 1), ("py", "x + 1 = 2\n", 1), ("py", "f(a=1, b)\n", 1), ("py", "x\nelse: pass\n", 2), ("py", "except: pass\n", 1), ("xml", "<a>\n<b c='1' c='2'/></a>", 2), ("xml", "<a>&nbsp;</a>", 1)],
)
def test_invalid_to_the_exact_parser_alone(lang, text, line):
    assert syntax.verdict(lang, text) == (1, "damage", line)


def test_limits_of_the_exact_parsers_do_not_count():
    deep = "[" * 3000 + "]" * 3000
    for lang, text in [("json", deep), ("json", "9" * 5000), ("py", "x = " + "9" * 5000 + "\n"), ("py", "x = " + "(" * 250 + "1" + ")" * 250 + "\n"), ("xml", "<?xml version='1.0' encoding='UTF-16'?><a/>")]:
        assert syntax.verdict(lang, text) == (0, None, None), (lang, text[:40])


def test_least_cost_by_brute_force():
    """Edit cost of a group equals the least over all edited token lists, on a small grammar."""
    import itertools

    g = chart.Grammar("File = ( a b? ) % c")
    ok = lambda t: g.exact("File", tuple(g.symbol(x) for x in t)) < 0
    valid = [t for n in range(7) for t in itertools.product("abc", repeat=n) if ok(t)]

    def distance(s, t):
        d = list(range(len(t) + 1))
        for i, x in enumerate(s, 1):
            prev, d[0] = d[0], i
            for j, y in enumerate(t, 1):
                prev, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, prev + (x != y))
        return d[-1]

    for s in itertools.product("abc", repeat=4):
        assert g.repair("File", tuple(g.symbol(x) for x in s), 8) == min(distance(s, t) for t in valid)


def test_groups_hold_the_least_cost_over_all_rules():
    """Several rules of a kind, one of which reads far and still costs more: none is left out, and the edits are those of a cheapest repair."""
    import itertools

    g = chart.Grammar("File = P[A] | P[B] | P[C]\nA = a b c d q q q\nB = z b c d e f g h\nC = ( a b? ) % c")
    content = tuple(g.symbol(x) for x in "abcdefgh")
    assert g.group("P", content)[0] == 1 and g.group("P", content)[2] == (("replace", 0),)
    for s in itertools.product("abcz", repeat=4):
        t = tuple(g.symbol(x) for x in s)
        cost, bits, where = g.group("P", t)
        assert cost == min(g.repair(r, t, 8) for r in "ABC") == len(where)
        assert all(0 <= i <= len(t) and what in ("insert", "delete", "replace") for what, i in where)


def test_edits_are_told_by_their_own_line():
    text = "class A {\n  void f() {\n    x();\n    y()\n    z();\n    int a = ;\n  }\n}\n"
    cost, edits = chart.parse(grammars.grammar("java"), grammars.java_tokens(text))
    assert cost == 2 and sorted(line for _, line in edits) in ([5, 6], [4, 6])


def test_causes():
    body = "class A {\n" + "  void f() { x(); }\n" * 40 + "}\n"
    assert syntax.verdict("java", body) == (0, None, None)
    assert syntax.verdict("java", body[:-3])[1] == "truncation"
    assert syntax.verdict("java", body.replace("x();", "<<<<<<< a\nx();\n=======\ny();\n>>>>>>> b\n", 1))[1] == "conflict"
    assert syntax.verdict("java", "def f(x):\n    return x\n\nprint(f(1))\n")[1] == "mismatch"
    assert syntax.verdict("java", body.replace("x();", "x(;", 1))[1] in ("damage", "mismatch")


FILE = "file_id bigint, path string, content string, committed_at string, lang string, edits int"


def test_frames_of_files(spark):
    rows = [(1, "r/a.py", "x = 1\n", "2024-01-02", "", 0), (2, "r/a.py", "x = (\n", "2024-01-01", "", 0), (3, "r/b.json", "{", "2024-01-01", None, 0), (4, "r/c.java", None, "2024-01-01", "", 0), (5, None, "x", None, "", 0), (6, "q/d.js", "let a = ;", None, "", 0), (6, "q/d.js", "let a = ;", None, "", 0), (7, "r/e.txt", "(", None, "", 0)]
    d = spark.createDataFrame(rows, FILE)
    v = syntax.check_files(d)
    assert {r.path: r.edits > 0 for r in v.collect()} == {"r/a.py": False, "r/b.json": True, "q/d.js": True}
    assert {(r.repo, r.lang, r.files, r.invalid, r.rate) for r in syntax.invalid_rates(v).collect()} == {("r", "py", 1, 0, 0.0), ("r", "json", 1, 1, 1.0), ("q", "js", 1, 1, 1.0)}
    assert syntax.check_files(d.limit(0)).count() == 0


def test_links_equal_brute_force(spark):
    r = random.Random(3)
    base = [r.sample(range(10**6), 60) for _ in range(12)]
    sets = []
    for i in range(90):
        s = set(r.choice(base))
        for _ in range(r.choice([0, 2, 4, 30])):
            s.discard(r.choice(sorted(s)))
            s.add(r.randrange(10**6))
        sets.append((f"f{i}", sorted(s)))
    sets += [("copy", sets[0][1]), ("empty", []), ("null", None)]
    members, links = near.links(spark.createDataFrame(sets, "id string, sh array<bigint>"))
    cls = {x.id: x.cid for x in members.collect()}
    assert "empty" not in cls and "null" not in cls and cls["copy"] == cls["f0"]
    content = {cls[i]: set(s) for i, s in sets if i in cls}
    found = {(x.cid, x.leader) for x in links.collect()}
    for a, b in found:
        assert len(content[a] & content[b]) >= 0.8 * len(content[a] | content[b])
    near_ = {c for c in content for o in content if c != o and len(content[c] & content[o]) >= 0.8 * len(content[c] | content[o])}
    linked = {x for p in found for x in p}
    assert len(near_ & linked) >= 0.98 * len(near_)


def test_links_of_a_star(spark):
    """Copies that are alike through their original only: none may be lost because another copy met the original first."""
    r = random.Random(5)
    original = list(range(500))
    sets = [("o", original)] + [(f"c{i}", sorted({*r.sample(original, 460), *(1000 * (i + 1) + k for k in range(40))})) for i in range(300)]
    members, links = near.links(spark.createDataFrame(sets, "id string, sh array<bigint>"))
    cls = {x.id: x.cid for x in members.collect()}
    found = {frozenset((x.cid, x.leader)) for x in links.collect()}
    assert sum(frozenset((cls["o"], cls[f"c{i}"])) in found for i in range(300)) >= 297
    star = near.stars(links, members.select("cid").distinct()).groupBy("leader").count()
    assert star.where(star["count"] >= 298).count() >= 1


def test_recall_of_pairs(spark):
    """Of all pairs of a similarity of 0.8 or more, found by brute force over small token sets, at least 0.97 are given, and no others."""
    r = random.Random(11)
    sets = []
    for _ in range(60):
        base = r.sample(range(10**5), r.choice([12, 25, 60, 300]))
        for _ in range(6):
            s = set(base)
            for _ in range(r.randrange(0, max(2, len(base) // 6))):
                s.discard(r.choice(sorted(s)))
                s.add(r.randrange(10**5))
            sets.append((len(sets), sorted(s)))
    members, links = near.links(spark.createDataFrame(sets, "id int, sh array<bigint>"))
    cls = {x.id: x.cid for x in members.collect()}
    content = {cls[i]: set(s) for i, s in sets}
    want = {(a, b) for a in content for b in content if a < b and len(content[a] & content[b]) >= 0.8 * len(content[a] | content[b]) - 1e-9}
    found = {(x.cid, x.leader) for x in links.collect()}
    assert found <= want and len(want) > 150 and len(found) >= 0.97 * len(want)


def test_classes_of_files(spark):
    accessor = "".join(f"    private String name{i}_;\n    public String getName{i}() {{ return name{i}_; }}\n    public void setName{i}(String value) {{ this.name{i}_ = value; }}\n" for i in range(9))
    gen = lambda c: f"package io.me.x;\npublic class {c} {{\n{accessor}}}\n"
    lib = "package org.lib;\npublic class Ring {\n  int head, tail; Object[] items;\n  void put(Object o) { if (tail == items.length) { grow(items.length * 2); } items[tail++] = o; }\n  Object take() { while (head < tail) { Object x = items[head]; items[head] = null; head += 1; if (x != null) return x; } return null; }\n}\n"
    pylib = "import os\n\ndef walk(top, seen=None):\n    seen = seen or set()\n    for name in sorted(os.listdir(top)):\n        path = os.path.join(top, name)\n        if path in seen:\n            continue\n        seen.add(path)\n        if os.path.isdir(path):\n            yield from walk(path, seen)\n        else:\n            yield path, os.stat(path).st_size\n"
    hand = "package io.me.y;\nimport java.util.List;\nclass Own {\n  // generated by hand, vendor copy of nothing\n  int sum(List<Integer> xs) { int t = 0; for (int x : xs) { t += x; } return t; }\n}\n"
    rows = [("me/src/A.java", gen("A")), ("me/src/B.java", gen("B")), ("me/vendor/Ring.java", lib), ("you/src/Ring.java", lib.replace("head += 1", "head++")), ("me/vendor/Own.java", hand), ("me/lib/walk.py", pylib), ("you/lib/walk.py", "# lib\n" + pylib), ("me/src/data.js", "module.exports = [" + ", ".join(map(str, range(900))) + "];"), ("me/web/a.js", "!function(t,n){" + "t.a=function(e){return e&&e.b?e.b():void 0};" * 20 + "}(a,b);"), ("me/x.js", None), ("me/y.py", ""), ("me/z.json", "[1]")]
    d = spark.createDataFrame([(i, p, c, "2024", "", 0) for i, (p, c) in enumerate(rows)], FILE)
    repos = spark.createDataFrame([("me", "io.me"), ("you", "io.you")], "repo string, base_package string")
    found = handwritten.classify(d, repos)
    assert {r.path: r.reason for r in found.collect()} == {"me/src/A.java": "generated", "me/src/B.java": "generated", "me/vendor/Ring.java": "copied", "you/src/Ring.java": "copied", "me/lib/walk.py": "copied", "you/lib/walk.py": "copied", "me/src/data.js": "data", "me/web/a.js": "compressed"}
    m = spark.createDataFrame([("1", ".\\me\\src\\A.java"), ("2", "/me/vendor/Own.java"), ("3", None)], "id string, file_path string")
    assert {r.id for r in handwritten.handwritten(m, found).collect()} == {"2", "3"}
    assert handwritten.classify(d.limit(0), repos).count() == 0


def test_families_within_a_repository(spark):
    """Without a digit in any name: record types and tables of one shape, also a mere pair of them, against copies of one file."""
    fields = ["region", "ledger", "parcel", "route", "vendor", "policy", "client", "worker"]
    record = lambda c: f"package io.me.z;\npublic class {c} {{\n" + "".join(f"    private String {c.lower()}{f};\n    public String get{c}{f}() {{ return {c.lower()}{f}; }}\n" for f in fields) + "}\n"
    table = lambda c: "module.exports = [" + ", ".join(f"[{ord(c) + i % 7}, {i % 3}]" for i in range(60)) + "];\n"
    hand = "def total(rows, seen):\n    out = {}\n    for row in sorted(rows):\n        if row in seen:\n            continue\n        out[row.name] = out.get(row.name, zero) + row.price * row.count\n        seen.add(row)\n    while out and limit(out):\n        out.popitem()\n    return [x for x in out.items() if x]\n"
    rows = [(f"me/a/{c}.java", record(c)) for c in ("Alpha", "Beta", "Gamma")] + [(f"me/b/{c}.js", table(c)) for c in "pqr"] + [(f"me/{c}/hand.py", hand) for c in "uvw"] + [(f"you/a/{c}.java", record(c).replace("io.me", "io.you").replace("String", "Text")) for c in ("Delta", "Sigma")]
    d = spark.createDataFrame([(i, p, c, "2024", "", 0) for i, (p, c) in enumerate(rows)], FILE)
    found = handwritten.classify(d, spark.createDataFrame([("me", "io.me"), ("you", "io.you")], "repo string, base_package string"))
    assert {r.path: r.reason for r in found.collect()} == {f"me/a/{c}.java": "generated" for c in ("Alpha", "Beta", "Gamma")} | {f"me/b/{c}.js": "data" for c in "pqr"} | {f"you/a/{c}.java": "generated" for c in ("Delta", "Sigma")}


def test_what_is_no_cluster_is_hand_written(spark):
    """Own files that others took, a mark that only some copies share, texts of marks only, odd columns."""
    own = "package io.me.ring;\nclass Ring {\n" + "".join(f"  int {a}(int {b}) {{ if ({b} {op} {k}) {{ return {a}({b} - {k}); }} while ({b} < limit) {b} {op2} step; return {b} * {k}; }}\n" for a, b, op, op2, k in [("f", "x", ">", "+=", 3), ("gg", "yy", "==", "*=", 44), ("h", "z", "<=", "|=", 5)]) + "}\n"
    rows = [("me/src/Ring.java", own), ("you/vendor/Ring.java", own), ("me/a.py", "\n" * 50), ("me/b.js", "// only a comment"), ("me/c.py", "#"), ("me/d.js", "'" * 3), ("me/e.js", "x" * 100_000)]
    d = spark.createDataFrame([(i, p, c, "2024", "", 0) for i, (p, c) in enumerate(rows)], FILE)
    found = handwritten.classify(d, spark.createDataFrame([("me", "io.me", "x"), ("you", "io.you", None)], "repo string, base_package string, content string"))
    assert {r.path: r.reason for r in found.collect()} == {"you/vendor/Ring.java": "copied"}
