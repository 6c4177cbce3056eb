"""Source text to rows: declarations, imports, classes, calls, conventions. All by column functions over (path, text).

Every extractor takes a table with one row a file and returns one row a fact. Text tiers are approximate by nature; a plug-in
(``extract(files) -> DataFrame``) may replace any of them.
"""

from __future__ import annotations

from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import base_of, dir_of

#: Folders that no scan enters; more of them for Python and for TypeScript (fixed values).
SKIP_DIRS = ("vendor", "testdata", "node_modules", "dist", "build", "target", ".git", ".hg", ".svn")
SKIP_PYTHON = ("__pycache__", ".tox", ".nox", ".mypy_cache", ".pytest_cache", ".ruff_cache", "venv", ".venv", "env", ".env", ".eggs")
SKIP_TS = (".next", "coverage")

#: Files at a root that tell its language, the most telling first (fixed values).
MARKERS = (
    ("go.mod", "go"), ("Cargo.toml", "rust"), ("CMakeLists.txt", "cpp"), ("pyproject.toml", "python"), ("setup.py", "python"), ("tsconfig.json", "typescript"), ("package.json", "typescript"),
    ("pom.xml", "java"), ("build.gradle", "java"), ("build.gradle.kts", "kotlin"), ("Package.swift", "swift"), ("build.zig", "zig"), ("Makefile", "c"),
)

#: First-match declaration patterns: language -> ((kind, pattern with one group), ...).
DECLARATIONS = {
    "go": (("method", r"^func \([^)]*\) (\w+)"), ("function", r"^func (\w+)"), ("interface", r"^type (\w+)(?:\[[^\]]*\])? interface\b"), ("struct", r"^type (\w+)(?:\[[^\]]*\])? struct\b"), ("type", r"^type (\w+)"), ("variable", r"^var (\w+)"), ("constant", r"^const (\w+)")),
    "python": (("function", r"^\s*async def (\w+)"), ("function", r"^\s*def (\w+)"), ("class", r"^\s*class (\w+)")),
    "rust": (("function", r"^\s*pub(?:\([^)]*\))? (?:async |const |unsafe )*fn (\w+)"), ("struct", r"^\s*pub(?:\([^)]*\))? struct (\w+)"), ("enum", r"^\s*pub(?:\([^)]*\))? enum (\w+)"), ("trait", r"^\s*pub(?:\([^)]*\))? (?:unsafe )?trait (\w+)"), ("type", r"^\s*pub(?:\([^)]*\))? type (\w+)"), ("module", r"^\s*pub(?:\([^)]*\))? mod (\w+)")),
    "typescript": (("function", r"^export (?:default )?(?:async )?function\*? (\w+)"), ("class", r"^export (?:default )?(?:abstract )?class (\w+)"), ("interface", r"^export interface (\w+)"), ("type", r"^export type (\w+)"), ("enum", r"^export (?:const )?enum (\w+)"), ("variable", r"^export (?:const|let|var) (\w+)")),
    "java": (("class", r"^\s*(?:public |final |abstract )*class (\w+)"), ("interface", r"^\s*(?:public )?interface (\w+)"), ("enum", r"^\s*(?:public )?enum (\w+)")),
    "c": (("struct", r"^(?:typedef )?struct (\w+)\s*\{"), ("function", r"^(?!\s|return|else)[\w][\w\s*]*?\b(\w+)\([^;]*$")),
}
DECLARATIONS["javascript"] = DECLARATIONS["typescript"]

#: Import patterns: language -> patterns with one group.
IMPORTS = {
    "go": (r'^(?:import )?\s*(?:[\w.]+ )?"([^"]+)"$',),
    "python": (r"^\s*from\s+([\w]+(?:\.\w+)*)\s+import\b", r"^\s*import\s+([\w.]+)"),
    "rust": (r"^\s*(?:pub )?use\s+([\w:]+)", r"^\s*extern crate (\w+)"),
    "typescript": (r"""^import (?!type )[^'"]*from\s+['"]([^'"]+)['"]""", r"""^import\s+['"]([^'"]+)['"]""", r"""^export [^'"]*from\s+['"]([^'"]+)['"]""", r"""require\(['"]([^'"]+)['"]\)"""),
    "java": (r"^import (?:static )?([\w.]+)",),
    "c": (r'^\s*#\s*include\s+"([^"]+)"',),
    "kotlin": (r"^import ([\w.]+)",),
    "csharp": (r"^using (?:static )?([\w.]+);",),
    "swift": (r"^import (?:\w+ )?(\w+)",),
    "zig": (r'@import\("([^"]+)"\)',),
}
IMPORTS["javascript"] = IMPORTS["typescript"]

EXTENSIONS = {"go": "go", "py": "python", "rs": "rust", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "java": "java", "c": "c", "h": "c", "kt": "kotlin", "cs": "csharp", "swift": "swift", "zig": "zig"}


class Extractor(Protocol):
    """A plug-in that gives facts of files (path, text)."""

    def extract(self, files: DataFrame) -> DataFrame: ...


def read_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, text): whole files below a root, one row each; the file index prunes by name before anything is read."""
    df = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).option("wholetext", "true").text(root)
    return df.select(F.regexp_replace(F.col("_metadata.file_path"), f"^.*?{root.rstrip('/')}/", "").alias("path"), F.col("value").alias("text"))


def with_language(files: DataFrame) -> DataFrame:
    m = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    return files.withColumn("language", m[F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))])


def skipped(path: Column, language: Column | None = None) -> Column:
    """Whether a path leads through a folder that scans leave out."""
    dirs = F.slice(F.split(path, "/"), 1, F.greatest(F.lit(0), F.size(F.split(path, "/")) - 1))
    out = F.exists(dirs, lambda d: d.isin(*SKIP_DIRS) | d.startswith("."))
    if language is not None:
        out = out | ((language == "python") & F.exists(dirs, lambda d: d.isin(*SKIP_PYTHON) | d.endswith(".egg-info"))) | (language.isin("typescript", "javascript") & F.exists(dirs, lambda d: d.isin(*SKIP_TS)))
    return out


def detect_language(files: DataFrame) -> DataFrame:
    """(root, language) of file paths: by the most telling marker at each root (column root, path relative to it)."""
    m = F.create_map(*[F.lit(x) for i, (f, _) in enumerate(MARKERS) for x in (f, i)])
    hit = files.where(~F.col("path").contains("/")).select("root", m[F.col("path")].alias("i")).where("i IS NOT NULL").groupBy("root").agg(F.min("i").alias("i"))
    names = F.array(*[F.lit(x[1]) for x in MARKERS])
    return files.select("root").distinct().join(hit, "root", "left").select("root", F.coalesce(F.get(names, F.col("i")), F.lit("unknown")).alias("language"))


def lines_of(files: DataFrame) -> DataFrame:
    """files plus (line, value), from line 1."""
    return files.select(*[c for c in files.columns if c != "text"], F.posexplode(F.split("text", r"\r?\n")).alias("n", "value")).withColumn("line", F.col("n") + 1).drop("n")


def declarations(files: DataFrame) -> DataFrame:
    """(path, package, name, kind, exported, line): the first matching pattern of each line; of equal names in a package the first."""
    rows = lines_of(with_language(files))
    found = F.lit(None).cast("struct<kind:string,name:string>")
    for lang, pats in DECLARATIONS.items():
        tries = [F.when(F.regexp_extract("value", p, 1) != "", F.struct(F.lit(k).alias("kind"), F.regexp_extract("value", p, 1).alias("name"))) for k, p in pats]
        found = F.when(F.col("language") == lang, F.coalesce(*tries)).otherwise(found)
    d = rows.withColumn("d", found).where("d IS NOT NULL").select("path", dir_of("path").alias("package"), "language", F.col("d.name").alias("name"), F.col("d.kind").alias("kind"), "line")
    exported = F.when(F.col("language") == "go", F.col("name").rlike("^[A-Z]")).when(F.col("language") == "python", ~F.col("name").startswith("_")).otherwise(F.lit(True))
    first = F.row_number().over(Window.partitionBy("package", "name").orderBy("path", "line"))
    return d.withColumn("r", first).where("r = 1").select("path", "package", "name", "kind", exported.alias("exported"), "line")


def imports(files: DataFrame) -> DataFrame:
    """(path, package, target, line) of import lines; relative Python imports are left out."""
    rows = lines_of(with_language(files))
    found = F.lit(None).cast("string")
    for lang, pats in IMPORTS.items():
        found = F.when(F.col("language") == lang, F.coalesce(*[F.nullif(F.regexp_extract("value", p, 1), F.lit("")) for p in pats])).otherwise(found)
    return rows.withColumn("target", found).where("target IS NOT NULL").select("path", dir_of("path").alias("package"), "target", "line")


def fold_path(path: Column) -> Column:
    """A path without . and .. segments."""
    step = lambda acc, x: F.when(x.isin("", "."), acc).when((x == "..") & (F.size(acc) > 0), F.slice(acc, 1, F.size(acc) - 1)).otherwise(F.concat(acc, F.array(x)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.expr("cast(array() as array<string>)"), step), "/")


def import_edges(imp: DataFrame, packages: DataFrame) -> DataFrame:
    """(src, dst, external, weight): imports resolved to known packages (package): exact, else the longest prefix, else the same last segment; otherwise external.

    Relative TypeScript paths are folded onto the importing folder first. All three tiers are equality joins.
    """
    rel = F.when(F.col("target").rlike(r"^\.{1,2}(/|$)"), fold_path(F.concat("package", F.lit("/"), "target"))).otherwise(F.regexp_replace(F.regexp_replace("target", r"::", "/"), r"(?<=\w)\.(?=\w)", "/"))
    i = imp.where("target IS NOT NULL").select("package", "target", rel.alias("t"))
    known = packages.select(F.col("package").alias("k")).where("k <> ''").distinct()
    targets = i.select("t").distinct()
    parts = F.split("t", "/")
    pre = targets.select("t", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("k"))
    by_prefix = pre.join(known, "k").groupBy("t").agg(F.max_by("k", F.length("k")).alias("p"))
    last = known.select(F.element_at(F.split("k", "/"), -1).alias("seg"), "k").groupBy("seg").agg(F.min("k").alias("s"))
    by_last = targets.select("t", F.element_at(parts, -1).alias("seg")).join(last, "seg").select("t", "s")
    hit = targets.join(by_prefix, "t", "left").join(by_last, "t", "left").select("t", F.coalesce("p", "s").alias("dst"))
    e = i.join(hit, "t").select(F.col("package").alias("src"), F.coalesce("dst", "target").alias("dst"), F.col("dst").isNull().alias("external")).where("src <> dst")
    return add_edges(e)


def add_edges(edges: DataFrame) -> DataFrame:
    """(src, dst, external, weight): repeated pairs add up; external as soon as one row says so first."""
    return edges.groupBy("src", "dst").agg(F.max("external").alias("external"), F.count(F.lit(1)).alias("weight"))


def usage_coupling(uses: DataFrame) -> DataFrame:
    """(src, dst, weight, call_sites, loc_surface) of uses (pkg, imp, ident, line): distinct names, uses and lines."""
    return uses.groupBy(F.col("pkg").alias("src"), F.col("imp").alias("dst")).agg(
        F.greatest(F.lit(1), F.countDistinct("ident")).alias("weight"), F.count(F.lit(1)).alias("call_sites"), F.countDistinct("line").alias("loc_surface")
    )


def prefix_projects(parts: dict[str, DataFrame], column: str = "package") -> DataFrame:
    """Union of sub-projects' tables, with their folder in front of the package."""
    return reduce(DataFrame.unionByName, [df.withColumn(column, F.concat_ws("/", F.lit(p), F.col(column))) for p, df in sorted(parts.items())])


def ctags_symbols(tags: DataFrame) -> DataFrame:
    """(path, package, name, kind, line) of ctags' JSON rows (_type, name, path, kind, line)."""
    kind = F.when(F.col("kind").isin("func", "function", "method"), "function").when(F.col("kind").isin("struct", "class"), "struct").when(F.col("kind").isin("interface", "trait"), "interface").otherwise(F.col("kind"))
    return tags.where("_type = 'tag' AND name IS NOT NULL").select("path", dir_of("path").alias("package"), "name", kind.alias("kind"), F.col("line").cast("int").alias("line"))


def classes(files: DataFrame) -> DataFrame:
    """(path, name, kind, line): structs, interfaces, classes, traits and enums."""
    return declarations(files).where(F.col("kind").isin("struct", "interface", "class", "trait", "enum")).select("path", "name", "kind", "line")


def implementations(files: DataFrame) -> DataFrame:
    """(from, to, kind): 'extends'/'implements' clauses, bases of Python classes and Rust impls."""
    rows = lines_of(with_language(files))
    cls = F.regexp_extract("value", r"class (\w+)", 1)
    ext = F.regexp_extract("value", r"class \w+(?:<[^>]*>)? extends ([\w.]+)", 1)
    imp = F.split(F.regexp_extract("value", r"implements ([\w.,<> ]+?)\s*\{", 1), r"\s*,\s*")
    bases = F.split(F.regexp_extract("value", r"^\s*class \w+\(([^)=]*)\)", 1), r"\s*,\s*")
    a = rows.where(F.col("language").isin("java", "typescript", "javascript")).select(cls.alias("from"), F.explode(F.array_union(F.array(F.struct(ext.alias("to"), F.lit("extends").alias("kind"))), F.transform(imp, lambda x: F.struct(x.alias("to"), F.lit("implements").alias("kind"))))).alias("x"))
    b = rows.where("language = 'python'").select(cls.alias("from"), F.explode(F.transform(bases, lambda x: F.struct(x.alias("to"), F.lit("extends").alias("kind")))).alias("x"))
    c = rows.where("language = 'rust'").select(F.regexp_extract("value", r"^impl(?:<[^>]*>)? [\w:]+(?:<[^>]*>)? for (\w+)", 1).alias("from"), F.struct(F.regexp_extract("value", r"^impl(?:<[^>]*>)? ([\w:]+)(?:<[^>]*>)? for \w+", 1).alias("to"), F.lit("implements").alias("kind")).alias("x"))
    u = a.union(b).union(c).select("from", "x.to", "x.kind")
    return u.where("from <> '' AND to <> '' AND to <> 'object'").distinct()


def nesting_depth(files: DataFrame) -> DataFrame:
    """(path, max_nesting): deepest curly nesting of each file, by a running depth over its brackets."""
    brackets = F.split(F.regexp_replace(F.regexp_replace("text", r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|//[^\n]*', ""), r"[^{}]", ""), "")
    zero = F.struct(F.lit(0).alias("d"), F.lit(0).alias("m"))
    step = lambda acc, c: F.struct((acc["d"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)).alias("d"), F.greatest(acc["m"], acc["d"] + F.when(c == "{", 1).otherwise(0)).alias("m"))
    return files.select("path", F.aggregate(brackets, zero, step)["m"].alias("max_nesting"))


def regex_calls(files: DataFrame) -> DataFrame:
    """(path, package, caller, callee): words before a round bracket in the text between one function's head and the next, keywords left out."""
    keywords = "if for switch return func go defer select case range make len cap append new panic recover print println copy delete close while catch def class".split()
    body = F.explode(F.split("text", r"(?m)^(?=func |def |fn |pub fn |function |export function )"))
    b = with_language(files).select("path", dir_of("path").alias("package"), body.alias("b"))
    name = F.regexp_extract("b", r"^(?:pub |export )?(?:func(?: \([^)]*\))?|def|fn|function) (\w+)", 1)
    rest = F.regexp_replace("b", r"^[^\n]*?\w+\s*(?=\()", "")
    return b.select("path", "package", name.alias("caller"), F.explode(F.array_distinct(F.regexp_extract_all(rest, F.lit(r"\b(\w+)\("), F.lit(1)))).alias("callee")).where((F.col("caller") != "") & ~F.col("callee").isin(*keywords))


def anchors(files: DataFrame) -> DataFrame:
    """(path, kind, name): where a reader starts: main and init functions, HTTP handlers, commands, tagged config structs, test suites."""
    rules = (("main", r"(?m)^func (main)\("), ("init", r"(?m)^func (init)\("), ("http_handler", r"(?m)^func (?:\([^)]*\) )?(\w+)\(\w+ http\.ResponseWriter, \w+ \*http\.Request\)"), ("command", r'&cobra\.Command\{\s*Use:\s*"(\w+)'), ("config", r"(?ms)^type (\w+) struct \{[^}]*?`(?:json|yaml|toml|mapstructure):"), ("test_suite", r"(?m)^func (Test\w*)\(\w+ \*testing\.[MT]\)"), ("main", r"(?m)^if __name__ == ['\"](__main__)['\"]:"))

    def found(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("name")))

    all_ = F.concat(*[found(k, p) for k, p in rules])
    return files.select("path", F.explode(all_).alias("a")).select("path", "a.kind", "a.name").distinct()


#: How projects lay out, test, configure and name files (fixed values).
STRUCTURE = ("cmd/", "internal/", "pkg/", "api/", "src/", "lib/", "test/", "docs/")
TESTS = ("_test.go", "_test.py", "test_", ".test.ts", ".spec.ts", ".test.js", ".spec.js", "_test.rs", "Test.java")
CONFIGS = ("config", ".env", "settings", ".yaml", ".yml", ".toml", ".json")


def conventions(files: DataFrame) -> DataFrame:
    """(category, pattern, count, examples): layout, test, config and naming habits; the count of tests and configs stops at the five examples kept."""
    base = base_of("path")
    structure = F.coalesce(*[F.when(F.col("path").startswith(p), p) for p in STRUCTURE])
    tests = F.coalesce(*[F.when(base.endswith(p) | base.startswith(p), p) for p in TESTS])
    configs = F.coalesce(*[F.when(base.contains(p), p) for p in CONFIGS])
    stem = F.regexp_extract(base, r"^(.*)\.go$", 1)
    naming = F.when(stem.rlike(r"^[a-z0-9]+(_[a-z0-9]+)*$") & ~stem.endswith("_test"), "snake_case").when(stem.rlike(r"^[a-z]+[A-Za-z0-9]*$"), "camelCase")
    each = F.array(*[F.struct(F.lit(c).alias("category"), p.alias("pattern")) for c, p in (("structure", structure), ("test", tests), ("config", configs), ("naming", naming))])
    rows = files.where(~skipped(F.col("path"))).select("path", F.explode(each).alias("x")).select("path", "x.*").where("pattern IS NOT NULL")
    top = rows.withColumn("r", F.row_number().over(Window.partitionBy("category", "pattern").orderBy("path")))
    g = top.groupBy("category", "pattern").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_list(F.when(F.col("r") <= 5, F.col("path")))), ",").alias("examples"))
    return g.select("category", "pattern", F.when(F.col("category").isin("test", "config"), F.least("n", F.lit(5))).otherwise(F.col("n")).alias("count"), "examples")


def source_snippet(files: DataFrame, edges: DataFrame, around: int = 2) -> DataFrame:
    """(source, target, file, n, text): the lines around each edge's (file, line); windows are exploded into equality keys."""
    want = edges.where("file IS NOT NULL AND line IS NOT NULL").select("source", "target", "file", F.explode(F.sequence(F.greatest(F.lit(1), F.col("line") - around), F.col("line") + around)).alias("n"))
    have = lines_of(files).select(F.col("path").alias("file"), F.col("line").alias("n"), F.col("value").alias("text"))
    return want.join(have, ["file", "n"]).select("source", "target", "file", "n", "text")


def split_types(signature: Column) -> Column:
    """Parts of a parameter list at the commas outside of brackets."""
    chars = F.split(signature, "")
    zero = F.struct(F.lit(0).alias("d"), F.lit("").alias("s"))
    step = lambda acc, c: F.struct((acc["d"] + F.when(c.isin("(", "[", "{", "<"), 1).when(c.isin(")", "]", "}", ">"), -1).otherwise(0)).alias("d"), F.concat(acc["s"], F.when((c == ",") & (acc["d"] == 0), F.lit("\u0001")).otherwise(c)).alias("s"))
    return F.filter(F.transform(F.split(F.aggregate(chars, zero, step)["s"], "\u0001"), lambda x: F.trim(x)), lambda x: x != "")


def go_signature(signature: Column) -> tuple[Column, Column]:
    """(parameter types, return types) of '(a T, b U) (V, error)'."""
    p = F.regexp_extract(signature, r"^\s*(?:func\s*\w*)?\(((?:[^()]|\([^()]*\))*)\)", 1)
    r = F.trim(F.regexp_replace(signature, r"^\s*(?:func\s*\w*)?\((?:[^()]|\([^()]*\))*\)", ""))
    types = F.transform(split_types(p), lambda x: F.regexp_replace(x, r"^\w+\s+(?=\S)", ""))
    return types, split_types(F.regexp_replace(r, r"^\((.*)\)$", "$1"))


_PARENS = r"\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)"


def signature_types(signature: Column) -> tuple[Column, Column]:
    """(parameter types, return types) of a signature in the style that its first word tells: function (TypeScript), func (Go), def (Python), fn or
    pub fn (Rust), else a type before the name (C). Parameters without a type are left out, and returns that say nothing; null without brackets."""
    s = F.trim(signature)
    inner = F.regexp_replace(F.regexp_extract(s, _PARENS, 0), r"^\(|\)$", "")
    rest = F.trim(F.regexp_replace(s, r"^[^(]*" + _PARENS, ""))
    parts = split_types(inner)
    none = F.expr("cast(array() as array<string>)")
    after = lambda colon: F.transform(F.filter(parts, lambda p: p.contains(":")), lambda p: F.trim(F.regexp_replace(p, colon, "")))
    one = lambda x, *empty: F.when(x.isin("", *empty), none).otherwise(F.array(x))
    arrow = F.trim(F.regexp_extract(rest, r"->(.*)$", 1))
    before_last = lambda x: F.when(x.rlike(r"\S\s+\S"), F.array_join(F.split(F.regexp_replace(x, r"\s+\S+$", ""), r"\s+"), " "))
    head = F.trim(F.regexp_extract(s, r"^([^(]*)\(", 1))
    typed_before = F.transform(F.filter(parts, lambda p: p != "void"), lambda p: F.coalesce(before_last(p), p))
    go_p, go_r = go_signature(s)
    styles = [
        (s.startswith("function "), after(r"^[^:]*:"), one(F.trim(F.regexp_extract(rest, r"^:(.*)$", 1)), "void")),
        (s.startswith("func"), go_p, go_r),
        (s.startswith("def "), after(r"^.*:"), one(arrow, "None")),
        (s.startswith("fn ") | s.startswith("pub fn "), after(r"^[^:]*:"), one(arrow, "()")),
    ]
    params, returns = typed_before, one(F.coalesce(before_last(head), F.lit("")), "void")
    for is_style, p, r in reversed(styles):
        params, returns = F.when(is_style, p).otherwise(params), F.when(is_style, r).otherwise(returns)
    known = s.contains("(")
    return F.when(known, params), F.when(known, returns)


def state_machines(files: DataFrame) -> DataFrame:
    """(path, name, states, initial): groups of at least three constants counted by iota, the initial one by its name, else the first."""
    block = F.explode(F.regexp_extract_all("text", F.lit(r"(?ms)^const \(\s*\n(\s*\w+ \w+ = iota\b.*?)^\)"), F.lit(1)))
    b = files.select("path", block.alias("b"))
    states = F.filter(F.regexp_extract_all("b", F.lit(r"(?m)^\s*([A-Z]\w*|[a-z]\w*)"), F.lit(1)), lambda x: x != "_")
    s = b.select("path", F.regexp_extract("b", r"^\s*\w+ (\w+) = iota", 1).alias("name"), states.alias("states")).where(F.size("states") >= 3)
    start = F.filter("states", lambda x: F.lower(x).rlike("init|start|idle|pending|new|unknown"))
    return s.withColumn("initial", F.when(F.size(start) > 0, F.get(start, F.lit(0))).otherwise(F.get("states", F.lit(0))))


def best_layer(rows: DataFrame, keys: list[str], quality: dict[str, int]) -> DataFrame:
    """Of facts from several extractors (column layer), those of the best one for each key."""
    q = F.create_map(*[F.lit(x) for kv in quality.items() for x in kv])
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.coalesce(q[F.col("layer")], F.lit(0))).alias("x")).select(*keys, *[F.col(f"x.{c}").alias(c) for c in rest])
