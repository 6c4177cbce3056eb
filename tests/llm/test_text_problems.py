import base64
import random

import pytest

from stratagraph.llm import mojibake, packing, provenance, repair_grammar, tokens
from stratagraph.llm.syntax import operator as syntax
from stratagraph.llm.syntax.engine import Grammar
from stratagraph.llm.syntax.grammars import LANGUAGES, grammar
from stratagraph.llm.syntax.reference_check import faults

GOOD = {
    "go": 'package a\n\nimport (\n\t"fmt"\n)\n\ntype T[K comparable, V any] struct {\n\tA, B map[K][]V `json:"a"`\n\t*Base\n}\n\nfunc (t *T[K, V]) F(x int, ys ...string) (n int, err error) {\n\tfor i, y := range ys {\n\t\tif v, ok := m[y]; ok && i < 3 {\n\t\t\tcontinue\n\t\t}\n\t}\n\tswitch z := x.(type) {\n\tcase int, *T:\n\t\treturn 0, nil\n\tdefault:\n\t\tgo func() { ch <- 1 }()\n\t}\n\tselect {\n\tcase v := <-ch:\n\t\t_ = v\n\t}\n\treturn len([]int{1, 2}), fmt.Errorf("x: %w", err)\n}\n',
    "python": 'import a.b as c\nfrom . import (d, e)\n\n@dec(1)\nasync def f(x: int = 1, *args, k, **kw) -> list[str]:\n    """doc"""\n    if (n := len(x)) > 1 and not y: return\n    elif z:\n        pass\n    else:\n        async with a as b, c:\n            yield {**d, "k": [i for i in x if i]}\n    try:\n        x[1:2, ::3] += lambda q, *r: q\n    except* (A, B) as e:\n        raise X from e\n    match p:\n        case {"a": 1} | [_, *rest] if rest:\n            pass\n',
    "java": 'package a.b;\nimport java.util.*;\n@Ann(x = {1, 2})\npublic final class A<T extends B & C> extends D<T[]> implements E, F {\n    private static final Map<String, List<int[]>> M = new HashMap<>() {{ put("a", null); }};\n    A(int... xs) throws X { super(xs); }\n    <R> R f(final T t) {\n        for (var e : M.entrySet()) { if (e instanceof Foo f && f.ok()) continue; else break; }\n        int[] a = {1, 2}, b = new int[3];\n        Runnable r = () -> {}; Function<A, B> g = A::new;\n        return switch (t) { case 1, 2 -> a[0]; default -> { yield (int) x >>> 2; } };\n    }\n    enum G { A(1) { void h() {} }, B; int v; }\n    record P(int x, int y) {}\n}\n',
    "rust": "#![allow(dead_code)]\nuse a::{b, c::*};\npub struct S<'a, T: Clone + 'a>(pub &'a T) where T: Send;\nimpl<'a, T> Tr for S<'a, T> {\n    type X = Vec<Option<T>>;\n    fn f(&mut self, x: &dyn Fn(i32) -> i32) -> Result<(), Box<dyn E>> {\n        let y = if let Some(z) = x { z? } else { return Err(\"a\".into()) };\n        match y { 1..=3 | 7 if y > 2 => {} P { a, ref b, .. } => f(|q: i32| q << 2), _ => unsafe { g::<u8>() }, }\n        for (i, v) in a.iter().enumerate() { println!(\"{} {{\", i); }\n        Ok(())\n    }\n}\nmacro_rules! m { ($x:expr) => { $x + 1 }; }\n",
    "c": '#include <stdio.h>\n#ifndef A\n#define A(x) \\\n  (x)\n#endif\ntypedef struct s { int a : 3; union { char *p; } u[4]; } s_t;\nstatic const unsigned long f(struct s *x, int (*cb)(void *, ...), foo_t y[static 3]) {\n    s_t z = { .a = 1, .u = { [0] = { 0 } } };\n    for (int i = 0; i < 3; i++) { if (x->a) goto end; else z.a = (int) sizeof(struct s) * y[i]; }\n    do { cb(x, "a" "b"); } while (0);\n    switch (z.a) { case 1: default: break; }\nend:\n    return (unsigned)z.a ? 1 : ~0UL;\n}\n',
    "javascript": "import a, { b as c } from './x.js';\nexport default class A extends B {\n  #p = 1;\n  static async *f({ a = 1, ...r }, [b]) { yield* g?.[1] ?? `t${a}`; }\n  get x() { return /[/]\\//g.test(y) }\n}\nconst f = async (x) => ({ x, [k]: 1, m() {} })\nlet y = x\n  .map((v) => v ** 2)\nfor (const [k, v] of Object.entries(o)) if (k) continue; else break\nlabel: do { x++ } while (x < 3)\nexport { f as g }\n",
    "typescript": "import type { A } from './a';\nexport interface I<T = string> extends J, K<T> {\n  readonly a?: string[];\n  (x: number): void;\n  [k: string]: unknown;\n  m<U>(this: I, ...r: U[]): asserts r is U[]\n}\nexport type M<T> = { readonly [K in keyof T]?: T[K] extends infer U ? U : never };\nabstract class C<T> implements I<T> {\n  private readonly x: Map<string, Array<number>> = new Map<string, Array<number>>();\n  constructor(public a: string, b?: number) { super(); }\n  abstract f(): void;\n}\nconst d = e as unknown as Record<string, number>;\nenum E { A = 1, B }\nfunction g(x: A | null): x is A { return x!.y<number>(1) }\ndeclare module 'm' { export function h(): void; }\n",
}


@pytest.mark.parametrize("language", LANGUAGES)
def test_syntax_of(language):
    text = GOOD[language]
    assert faults(language, text) is None
    assert faults(language, text.replace("\n", "\r\n")) is None
    rnd = random.Random(1)
    bracket = [i for i, c in enumerate(text) if c in "{}" and text[i - 1 : i + 2].strip() in ("{", "}")]
    for i in rnd.sample(bracket, min(4, len(bracket))):
        assert faults(language, text[:i] + text[i + 1 :]) is not None
    cut = text.rindex("return") + 7 if "return" in text else len(text) // 2
    assert faults(language, text[:cut] + "\n<<<<<<< ours\nx\n=======\ny\n>>>>>>> theirs\n" + text[cut:]) is not None
    for other in LANGUAGES:
        if other != language and (language, other) != ("javascript", "typescript"):
            assert faults(other, text) is not None, other
    assert (faults(language, "") is None) == (language != "go")


def test_pairs_come_from_the_grammar():
    g = Grammar("file = 'a' P.in? 'b'* 'c'\nin = 'x' | 'y' 'z'\n", "file")
    assert g.pairs() == {("<start>", "a"), ("a", "("), ("a", "b"), ("a", "c"), (")", "b"), (")", "c"), ("b", "b"), ("b", "c"), ("c", "<end>"), ("(", "x"), ("(", "y"), ("x", ")"), ("z", ")"), ("y", "z"), ("x", "x"), ("x", "y"), ("z", "x"), ("z", "y"), ("(", ")"), ("c", "a")}
    assert g.match("file", ["a", "(", "b", "c"]) == ((1, "in"),) and g.match("file", ["a", "("]) is None
    assert all(len(grammar(x).pairs()) > 100 for x in LANGUAGES)


CHAINS = {
    "go": ("package a\n\nfunc f(x int) int {{\n{}\treturn 0\n}}\n", "\tif x == 0 {\n\t\tx = 1\n\t}", " else if x == 1 {\n\t\tx = 2\n\t}"),
    "python": ("def f(x):\n{}    return 0\n", "    if x == 0:\n        x = 1", "\n    elif x == 1:\n        x = 2"),
    "java": ("class A {{ int f(int x) {{\n{}\nreturn 0; }} }}\n", "if (x == 0) { x = 1; }", " else if (x == 1) { x = 2; }"),
    "rust": ("fn f(x: i32) -> i32 {{\n{}\n0 }}\n", "if x == 0 { g(); }", " else if x == 1 { g(); }"),
    "c": ("int f(int x) {{\n{}\nreturn 0; }}\n", "if (x == 0) { x = 1; }", " else if (x == 1) { x = 2; }"),
    "javascript": ("function f(x) {{\n{}\nreturn 0 }}\n", "if (x === 0) { x = 1 }", " else if (x === 1) { x = 2 }"),
    "typescript": ("function f(x: number): number {{\n{}\nreturn 0 }}\n", "if (x === 0) { x = 1 }", " else if (x === 1) { x = 2 }"),
}
TERNARY = {"python": "1 if x else ", "java": "x == 1 ? 2 : ", "c": "x == 1 ? 2 : ", "javascript": "x == 1 ? 2 : ", "typescript": "x == 1 ? 2 : "}


@pytest.mark.parametrize("language", LANGUAGES)
def test_long_chains_parse(language):
    n = 5000
    frame, head, more = CHAINS[language]
    text = frame.format(head + more * n + "\n")
    assert faults(language, text) is None and faults(language, frame.format(head + more * n + " else else\n")) is not None
    end = "" if language in ("go", "python") else ";"
    let = {"go": "\tx = ", "python": "    x = ", "rust": "let x = "}.get(language, "x = ")
    assert faults(language, frame.format(let + "x + " * n + "1" + end + "\n")) is None
    if language in TERNARY:
        assert faults(language, frame.format(let + TERNARY[language] * n + "0" + end + "\n")) is None


def test_wild_groups_hold_any_pairs_and_others_do_not():
    assert faults("rust", "fn f() { m!(a b => [c, ; d]); }\n") is None
    assert faults("rust", "fn f() { m(a b => c); }\n") is not None
    assert faults("c", "int x __attribute__((a b, 3 : 4));\n") is None
    assert len(grammar("rust").pairs()) < 0.5 * len(grammar("rust").tokens) ** 2


def test_syntax_operator(spark):
    rows = [(i * 10, "p", f"f{i}.{e}", None if i % 2 else f"f{i}.{e}", t, 7) for i, (e, t) in enumerate([("go", GOOD["go"]), ("py", GOOD["python"]), ("java", GOOD["java"]), ("rs", GOOD["rust"]), ("c", GOOD["c"]), ("js", GOOD["javascript"]), ("ts", GOOD["typescript"])])]
    bad = [(1, "p", "a.go", None, GOOD["go"][:-2], 7), (2, "p", "a.go", "b.PY", "def f(:\n", 7), (3, None, "x.c", None, "int a[3;]\n", 7), (4, "p", "x.h", None, "#if 1\nint x;\n", 7), (5, "p", "e.go", None, "", 7), (6, "p", "e.js", None, "(" * 3000, 7)]
    fine = [(120, "p", "e.py", None, "", 7), (21, "p", "n.go", None, None, 7), (22, "p", "README.md", None, "# x (", 7), (23, None, None, None, "x (", 7)]
    df = spark.createDataFrame(rows + bad + bad[:2] + fine, "file_id long, project string, path string, rel_path string, source string, row int")
    assert sorted(r["file_id"] for r in syntax.unparsable(df).collect()) == [1, 2, 3, 4, 5, 6]
    assert syntax.unparsable(df.limit(0)).isEmpty()
    projects = spark.createDataFrame([("p", "go")], "path string, language string")
    one = [r for r in syntax.rates(df, projects).collect() if r["project"] == "p"][0]
    assert (one["files"], one["unparsable"]) == (14, 5)


@pytest.fixture(scope="module")
def vocabulary():
    with open(tokens.DEFAULT_RANKS, "rb") as f:
        return tokens.Vocabulary.from_bytes(f.read())


TEXTS = [None, "", "   ", "Hello world", "<|endoftext|>", "naïve café — 漢字 🎉\u200d", "a" * 5000, "\x00\x01\ufffd", "don't  stop\n\n\tnow  ", "Ã¢â‚¬â„¢" * 50, "=" * 777, "1234567890" * 30, " \u00a0\u3000x"]


def reference_encoding():
    import tiktoken

    with open(tokens.DEFAULT_RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encoding(spark, vocabulary):
    want = reference_encoding()
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, ids int")
    got = {r["doc_id"]: r["ids"] for r in tokens.encode(df).collect()}
    assert got == {i: want.encode_ordinary(t or "") for i, t in enumerate(TEXTS)}
    assert {r["doc_id"]: r["n"] for r in tokens.count_tokens(df).collect()} == {k: len(v) for k, v in got.items()}
    assert tokens.encode(df.limit(0)).isEmpty()


def test_prefix_table_edits(vocabulary):
    want, rnd = reference_encoding(), random.Random(2)
    for _ in range(300):
        s = bytes(rnd.choice(b"aab  the-==\xc3\x83ing0") for _ in range(rnd.randint(1, 200)))
        t = tokens.PrefixTable(vocabulary, s[:10])
        t.append(s[10:])
        a = rnd.randint(0, len(s))
        b, new = rnd.randint(a, len(s)), bytes(rnd.choice(b"abth-=") for _ in range(rnd.randint(0, 5)))
        t.replace(a, b, new)
        s = s[:a] + new + s[b:]
        assert t.data == s and t.ids() == (want._core_bpe.encode_single_piece(s) if s else [])


def test_packing(spark):
    rnd = random.Random(4)
    sizes = [(i, rnd.choice([0, 7, 7, 7, rnd.randrange(1, 900), rnd.randrange(1, 7000)]), "x") for i in range(3000)] + [(5, 100, "x"), (5, 100, "x"), (None, 3, "x"), (6, None, "x")]
    df = spark.createDataFrame(sizes, "doc_id long, n int, part string")
    out = packing.pack(df, 2048, 64).collect()
    fill = {}
    for r in out:
        if r["container_id"] is not None:
            fill[r["container_id"]] = fill.get(r["container_id"], 0) + r["tokens"]
            assert 0 < r["tokens"] <= 2048
        else:
            assert r["tokens"] == 0
    assert max(fill.values()) <= 2048 and sum(fill.values()) == sum(n or 0 for _, n, _ in sizes)
    assert 1 - sum(fill.values()) / (len(fill) * 2048) < 0.02
    assert len(out) == sum(max(1, -(-(n or 0) // 2048)) for _, n, _ in sizes)
    assert packing.pack(df.limit(0)).isEmpty()


def test_bucket_bounds_are_optimal():
    import itertools

    rnd = random.Random(6)
    for _ in range(20):
        hist = {rnd.randrange(1, 40): rnd.randrange(1, 9) for _ in range(9)}
        sizes = sorted(hist)
        cost = lambda bounds: sum(c * (min(b for b in bounds if b >= s) - s) for s, c in hist.items())
        for k in (1, 2, 3, 4):
            best = min(cost((*x, sizes[-1])) for x in itertools.combinations(sizes[:-1], min(k, len(sizes)) - 1))
            assert cost(packing.bucket_bounds(hist, k)) == best


PLAIN = ["Der Prüflauf verlässt die geänderte Schlüsseltabelle.", "C’est réglé depuis l’été, déjà là.", "Модуль разбора хранит старые правила.", "The naïve fix — it’s fine… costs €5.", "設定ファイルを置き換えた。"]
BOM = "\ufeff"


def damage(text, true, wrong):
    return mojibake.from_bytes(text.encode(true), wrong)


def test_mojibake(spark):
    docs = [(i, PLAIN[i % 5] + f" Nr {i}. " + PLAIN[(i * 3) % 5], "s", "k") for i in range(600)]
    bad = {1000: damage(PLAIN[0], "utf-8", "cp1252"), 1001: "Ein Satz. " + damage(PLAIN[0], "utf-8", "cp437"), 1002: damage(damage(PLAIN[1], "utf-8", "cp1252"), "utf-8", "cp1252"), 1003: damage(PLAIN[2], "cp1251", "koi8-r"), 1004: "pr\ufffdft regelm\ufffd\ufffdig", 1005: damage(PLAIN[4], "utf-8", "latin-1"), 1006: damage(BOM + PLAIN[3], "utf-8", "cp1252")}
    good = {2000: 'Test data: input "Ã©", expected "é". More.', 2001: None, 2002: "", 2003: " \t", 2004: "plain ascii", 2005: "SÃO LIMITAÇÕES", 2006: "If it shows `â€“` where `–` was meant."}
    rows = docs + [(k, v, "s", None) for k, v in {**bad, **good}.items()] + [(1000, bad[1000], None, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, kind string").withColumn("gain", __import__("pyspark").sql.functions.lit(1))
    out = {r["doc_id"]: r for r in mojibake.restore(df).collect()}
    assert set(out) == set(bad)
    assert out[1000]["repaired"] == PLAIN[0] and out[1002]["repaired"] == PLAIN[1] and out[1003]["repaired"] == PLAIN[2] and out[1001]["repaired"].endswith(PLAIN[0])
    assert out[1004]["lost"] == 3 and out[1004]["chain"] == ""
    assert sorted(r["doc_id"] for r in mojibake.found(df).collect()) == sorted([*bad, 1000])
    assert mojibake.restore(df.limit(0)).isEmpty()


def test_re_pair_round_trip():
    import numpy as np

    rnd = random.Random(8)
    for _ in range(60):
        codes = [rnd.randrange(rnd.choice([1, 2, 5])) for _ in range(rnd.randrange(1, 120))]
        seq, rules, t = repair_grammar.infer(np.array(codes))
        expand = lambda c: [c] if c < t else expand(rules[c - t][0]) + expand(rules[c - t][1])
        assert [x for c in seq for x in expand(c)] == codes
        pairs = list(zip(seq, seq[1:]))
        for p in set(pairs):  # no pair is left that could be replaced twice
            at = [i for i, q in enumerate(pairs) if q == p]
            assert len(at) < 2 or (p[0] == p[1] and len(at) < 3 and at[-1] - at[0] == len(at) - 1)
        occ = repair_grammar.occurrences(seq, rules, t)
        assert all(int(o) >= 2 for o in occ)


def test_global_rules_do_not_depend_on_the_place():
    import numpy as np

    rnd = np.random.default_rng(1)
    body = rnd.integers(0, 2**62, 400).astype(np.uint64)
    a, n = repair_grammar.global_rules(np.concatenate([rnd.integers(0, 2**62, 50).astype(np.uint64), body]))
    b, m = repair_grammar.global_rules(np.concatenate([body, rnd.integers(0, 2**62, 80).astype(np.uint64)]))
    shared = set(a.tolist()) & set(b.tolist())
    assert int(n.sum()) == 450 and sum(int(y) for x, y in zip(b.tolist(), m) if x in shared) > 300


def test_provenance(spark):
    hand = "package a\n\nfunc Run(x int) error {\n\tif x > 3 {\n\t\treturn nil\n\t}\n\ty := load(x, \"k\")\n\tfor _, v := range y.Items {\n\t\tv.Mark()\n\t}\n\tdefer y.Close()\n\treturn y.Check(x<<2, 'c')\n}\n"
    getters = "package a\n\n" + "".join(f"func (m *T) Get{i}() string {{\n\tif m != nil {{\n\t\treturn m.F{i}\n\t}}\n\treturn \"\"\n}}\n\n" for i in range(12))
    rnd = random.Random(3)
    blob = "const x =\n" + "".join("  '" + "".join(rnd.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(76)) + "' +\n" for _ in range(12)) + "  '';\n"
    table = "var t = []byte{\n" + "".join("    " + " ".join(f"0x{rnd.randrange(256):02x}," for _ in range(16)) + "\n" for _ in range(30)) + "}\n"
    minified = "".join(f"function a{i}(b,c){{var d=b.x{i};return d&&c(d,{i})||!1}}" for i in range(20))
    say = ["\tz{0} := g{1}(a, {2})\n", "\tif a > {0} {{\n\t\treturn h{1}(a)\n\t}}\n", "\tm{0}[a] = append(m{1}, {2})\n", "\tdefer q{0}.Close()\n", "\tfor i := range k{0} {{\n\t\tu{1}(i, a)\n\t}}\n", "\tc{0} <- a.b{1}\n"]
    body = lambda: "".join(rnd.choice(say).format(*[rnd.randrange(99) for _ in range(3)]) for _ in range(rnd.randrange(2, 6)))
    lib = "// Copyright (c) 2020 the libx authors.\n\npackage libx\n\n" + "".join(f"func F{i}(a int) int {{\n{body()}\treturn a\n}}\n" for i in range(12))
    altered = lib.partition("\n\n")[2].replace("func F3", "func Renamed")
    rows = [
        (1, "p", "a.go", hand, False), (2, "p", "b.go", getters, True), (3, "p", "c.js", blob, True), (4, "p", "d.go", table, True), (5, "p", "e.js", minified, True), (6, "p", "f.go", altered, True),
        (7, "p", "g.go", "// Code generated by gen. DO NOT EDIT.\n" + hand, True), (8, "p", "h.go", hand + '\nconst Head = "// Code generated by gen. DO NOT EDIT."\n', False), (9, "p", "i.go", "// This file is not auto-generated; edit it by hand.\n" + hand, False),
        (10, "p", "vendor/libx/j.go", hand, True), (11, "p", "vendors/x/k.go", hand, False), (12, "p", "l.go", "// Vendored from libx 1.2; local patches are listed.\n" + hand, True), (13, "p", "m.go", "// Formerly vendored from libx, rewritten since.\n" + hand, False),
        (14, "p", "third_party/libx/n.go", None, True), (15, None, None, None, False), (16, "p", "o.go", "", False), (17, "p", "q.go", hand + '\nconst key = "' + "Q" * 90 + '"\n', False), (18, "p", "r.go", "// Copyright (c) 2020 the libx authors.\n" + hand, True),
    ]
    other = "package y\n\n" + "".join(f"func G{i}(a int) int {{\n{body()}\treturn a\n}}\n" for i in range(12))
    # A library that no table knows is told by the rules that two projects share; twice in one project, it is the project's own.
    rows += [(19, "p", "s.go", other, True), (20, "q", "t.go", other.replace("func G2", "func Other"), True)]
    own = "package z\n\n" + "".join(f"func H{i}(a int) int {{\n{body()}\treturn a\n}}\n" for i in range(12))
    rows += [(22, "p", "v.go", own, False), (23, "p", "w.go", own.replace("func H2", "func Other"), False)]
    df = spark.createDataFrame([(i, p, n, n, s, 1) for i, p, n, s, _ in rows] + [(2, "p", "./b.go", "b.go", getters, 1)], "file_id long, project string, path string, rel_path string, source string, generated int")
    tp = spark.createDataFrame([("libx", "src/x.go", lib), ("liby", None, None)], "lib string, rel_path string, source string")
    got = {r["file_id"] for r in provenance.not_handwritten(df, tp).collect()}
    assert got == {r[0] for r in rows if r[4]}
    counts = {r["evidence"]: r for r in provenance.evidence_counts(df, tp).collect()}
    assert counts["shared_rules"]["files"] >= 2 and counts["vendor_path"]["beyond_grammars"] == counts["vendor_path"]["files"] and counts["third_party_rules"]["beyond_grammars"] == 0
    assert provenance.not_handwritten(df.limit(0), tp).isEmpty() and {6} & {r["file_id"] for r in provenance.not_handwritten(df, tp.limit(0)).collect()} == set()


def test_mojibake_next_to_intact_characters(spark):
    hurt = lambda t: damage(t, "utf-8", "cp1252")
    assert mojibake.undo("“core" + hurt("”"), "cp1252>utf-8") == "“core”" and mojibake.undo("“core”", "cp1252>utf-8") is None
    assert mojibake.undo("設定" + hurt("ファイル") + "を置き換えた。", "cp1252>utf-8") == PLAIN[4]
    assert mojibake.undo("設定" + damage("ファイルを", "utf-8", "cp1251"), "cp1251>utf-8") == "設定ファイルを"
    docs = [(i, PLAIN[i % 5] + f" Nr {i}. " + PLAIN[(i * 3) % 5] + " Die “alte” Regel.", "s", "k") for i in range(600)]
    bad = {1000: ("The “core" + hurt("”") + " rule.", "The “core” rule."), 1001: ("設定" + hurt("ファイル") + "を置き換えた。", PLAIN[4])}
    df = spark.createDataFrame(docs + [(k, v[0], "s", "k") for k, v in bad.items()] + [(2000, "The “core” rule.", "s", "k")], "doc_id long, text string, source string, kind string")
    assert {r["doc_id"]: r["repaired"] for r in mojibake.restore(df).collect()} == {k: v[1] for k, v in bad.items()}


def test_mojibake_in_long_unbroken_runs():
    text = "設定ファイルを置き換えた。" * 350
    model = mojibake.CharModel(__import__("numpy").zeros(mojibake.SIZE), 0.0)
    for g in mojibake.CharModel.grams(text):
        for slot in mojibake._slots(g):
            model.counts[slot] += 1
        model.total += 1
    hurt = damage(text, "utf-8", "cp1252")
    # ASCII punctuation ends a unit, and nothing else does; the whole run comes back.
    assert [hurt[i:j] for i, j in mojibake.units(hurt)] == [hurt]
    chains = {plain: chains for plain, _, chains in model.candidates(hurt)}
    assert "cp1252>utf-8" in chains[text] and mojibake.repair("x " + hurt, [("cp1252>utf-8", -5.0)], model) == ("cp1252>utf-8", "x " + text)
    assert mojibake.undo(text[:4100] + damage(text[4100:], "utf-8", "cp1252"), "cp1252>utf-8") == text


def test_mojibake_of_two_kinds_in_one_text(spark):
    docs = [(i, PLAIN[i % 5] + f" Nr {i}. " + PLAIN[(i * 3) % 5], "s", "k") for i in range(600)]
    hurt = damage(PLAIN[0], "utf-8", "cp1252") + " " + damage(PLAIN[2], "cp1251", "koi8-r")
    df = spark.createDataFrame(docs + [(1000, hurt, "s", "k")], "doc_id long, text string, source string, kind string")
    assert {r["doc_id"]: r["repaired"] for r in mojibake.restore(df).collect()} == {1000: PLAIN[0] + " " + PLAIN[2]}
