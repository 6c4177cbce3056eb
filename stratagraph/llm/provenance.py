"""Files that nobody wrote by hand in their project (problem 6), by grammars over their tokens.

* Generated: a Re-Pair grammar is inferred over each file's tokens, with names, numbers and strings reduced to their class. Where
  the best one or two rules, with all their occurrences, make up most of a file, a program wrote it.
* Data in code form: literals that their own Re-Pair grammar hardly shortens make up most of the file.
* Copied from third parties: rules over the tokens as written are named by their content, so that they can be compared over all
  repositories; a file that mostly consists of rules of known third-party files is a copy, renamed or altered as it may be, and so
  is one with long stretches of rules that other projects hold as well.
* Minified: the code has hardly any line ends.
* What a comment or the path itself declares (a generator's notice, an upstream's notice, a folder of vendored code) tells those
  files apart whose tokens look like any other's. Only comments count, never strings that hold such words, and not notices that
  deny it or speak of the past.

A file's tokens make one grammar, however long it is. Literals are measured in pieces of 4,000 symbols, as even chance repeats pairs in
longer ones, so that the share means the same at every length.

Defined cases: a null source leaves the path's evidence; null path and rel_path leave the source's; empty sources are hand-written;
repeated rows and re-scans give one result row; a null file_id gives a null result id; a third-party table that is empty or has
null sources is allowed; extra columns are never read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import checkpoint, lookup, spread
from .repair_grammar import global_rules, infer, lengths, occurrences, tokens

PIECE = 4_000
#: Shares from which a file counts: of the best rule, of the best two, of incompressible literals, of third-party rules; characters a line.
ONE_RULE, TWO_RULES, BLOB, COPY, LINE = 0.7, 0.72, 0.6, 0.5, 150
#: Rules of so many tokens that several projects hold make a copy where they are this share of a file and so many tokens; shorter ones are shared by chance.
LONG_RULE, SHARED, SHARED_TOKENS = 20, 0.2, 60

#: What notices say (fixed values). The second pattern denies the first.
GENERATED = re.compile(
    r"(?i)\b(?:code|file|source) (?:was |is |has been )?(?:auto[- ]?|automatically )?generated (?:by|from|via|using|with)\b|^\W*(?:auto[- ]?)?generated (?:by|from|via|using|with|code|file)\b|\bautogenerated (?:by|from|via|using|with|code|file)\b"
    r"|@generated\b|<auto-?generated|\bautomatically generated (?:by|from|via|using|with|code|file)\b|\bmachine[- ](?:written|generated|made) (?:output|code|file|by)\b|(?-i:\bDO NOT EDIT\b)|\bdo not (?:edit|modify) (?:it|this file|manually|by hand)\b"
    r"|\bautomatisch (?:erzeugt|generiert|erstellt)\b|\bgénéré automatiquement\b|\bgenerado automáticamente\b|\bgerado automaticamente\b|\bgenerato automaticamente\b|\bautomatycznie wygenerowan|автоматически сгенерирован|сгенерирован автоматически|自動生成|自动生成"
    r"|^\W*line \S+\.y:\d+"
)
NOT_GENERATED = re.compile(r"(?i)\bnot (?:an? )?(?:auto[- ]?|automatically |machine[- ])?generated\b|\bedit it by hand\b|\bno longer generated\b|\bformerly generated\b|\bused to be generated\b")
UPSTREAM = re.compile(
    r"(?i)\bupstream: \S+@|\bunmodified third[- ]party\b|\bcopied (?:verbatim|unchanged|as is) from\b|\bmirror of \S+ release\b|\b(?<!formerly )vendored from \S+ v?\d|\bpart of \S+ v?\d[\w.]*\. imported\b|\bthird[- ]party (?:file|code|copy)\b"
    r"|^/\*! \S+ v?\d"
)
NOT_UPSTREAM = re.compile(r"(?i)\bformerly\b|\brewritten\b|\bno longer\b|\bnot (?:a )?(?:third[- ]party|vendored|copied)\b")
OWNER = re.compile(r"(?i)copyright (?:\(c\)|©) ?\d{4}(?:-\d{4})?,? (?:the )?([\w.-]+) (?:authors|contributors|developers)\b")
VENDOR_PATH = r"(?i)(^|/)(_?vendor|third[_-]?party|external|node_modules|site-packages|bower_components)/[^/]+/"
GENERATED_PATH = r"(?i)(^|/)(gen|generated)/|(^|/)zz_generated\.|\.(gen|generated|pb)\.\w+$|_(gen|generated|pb|pb2|pb2_grpc)\.\w+$|[a-z](Grpc|Generated)\.(?-i:java)$"
MINIFIED_PATH = r"(?i)\.(min|bundle)\.(js|css|mjs)$"


def rule_shares(syms: list[str]) -> tuple[float, float]:
    """Shares of a file's tokens that its best rule, and its best two that do not hold each other, make up; of rules with at least 7 tokens that come at least 5 times."""
    number: dict[str, int] = {}
    seq, rules, terminals = infer(np.array([number.setdefault(s, len(number)) for s in syms], np.int64))
    size, times = lengths(rules, terminals), occurrences(seq, rules, terminals)
    good = sorted((i for i in range(len(rules)) if size[i] >= 7 and times[i] >= 5), key=lambda i: (-times[i] * size[i], i))
    if not good:
        return 0.0, 0.0
    best = good[0]
    below: set[int] = set()
    todo = [best]
    while todo:
        for x in rules[todo.pop()]:
            if x >= terminals and x - terminals not in below:
                below.add(x - terminals)
                todo.append(x - terminals)
    holds = [False] * len(rules)
    for i, (a, b) in enumerate(rules):
        holds[i] = i == best or any(x >= terminals and holds[x - terminals] for x in (a, b))
    second = next((i for i in good[1:] if i not in below and not holds[i]), None)
    one = int(times[best]) * size[best]
    return one / len(syms), (one + (int(times[second]) * size[second] if second is not None else 0)) / len(syms)


def blob_share(syms: list[str], literals: list[str], chars: int) -> float:
    """Share of a source that is literals which a grammar hardly shortens: long strings by their characters, numbers by their values."""
    # Words between blanks are prose, which only a longer text would show to be compressible.
    long = [x for x in literals if len(x) > 60 and x[0] in "\"'`" and x.count(" ") < 0.02 * len(x)]
    numbers = [x for x in literals if x[0] not in "\"'`"]
    out = 0.0
    payload = "".join(re.sub(r"[^\w+/=\\-]+", " ", x) for x in long)
    if len(payload) > 200 and incompressible([ord(c) for c in payload], 0.72):
        out += sum(map(len, long)) / max(1, chars)
    if len(numbers) > 60 and syms.count("N") > 0.35 * len(syms) and incompressible([hash_of(x) for x in numbers], 0.7):
        out += (len(numbers) + syms.count(",")) / max(1, len(syms))
    return out


def hash_of(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "replace"))


def incompressible(payload: list[int], least: float) -> bool:
    """Whether the grammars of a payload's pieces keep at least this share of its size."""
    kept = 0
    for at in range(0, len(payload), PIECE):
        _, codes = np.unique(np.array(payload[at : at + PIECE], np.int64), return_inverse=True)
        seq, rules, _ = infer(codes)
        kept += len(seq) + 2 * len(rules)
    return kept >= least * len(payload)


def _written(source: str, hash_comments: bool) -> np.ndarray:
    """Hashes of the tokens as written, without comments."""
    from .repair_grammar import TOKEN

    out = []
    for m in TOKEN.finditer(source):
        kind = m.lastgroup
        if kind == "com" and not (hash_comments and m.group()[1:2] == "/"):
            continue
        if kind == "hash" and hash_comments:
            continue
        out.append(hash_of(m.group()))
    return np.array(out, np.uint64)


def notices(comments: list[tuple[int, str]]) -> tuple[bool, bool, str | None]:
    """(generated, from upstream, owner of the first copyright line) as the comments declare."""
    generated = upstream = False
    owner = None
    for _, c in comments:
        generated = generated or bool(GENERATED.search(c) and not NOT_GENERATED.search(c))
        upstream = upstream or bool(UPSTREAM.search(c) and not NOT_UPSTREAM.search(c))
        if owner is None and (m := OWNER.search(c)):
            owner = m.group(1).lower()
    return generated, upstream, owner


_FACTS = [
    T.StructField("one_rule", T.DoubleType()),
    T.StructField("two_rules", T.DoubleType()),
    T.StructField("blob", T.DoubleType()),
    T.StructField("line", T.DoubleType()),
    T.StructField("says_generated", T.BooleanType()),
    T.StructField("says_upstream", T.BooleanType()),
    T.StructField("owner", T.StringType()),
    T.StructField("rules", T.ArrayType(T.LongType())),
    T.StructField("sizes", T.ArrayType(T.IntegerType())),
]


def facts(rows: DataFrame) -> DataFrame:
    """rows of (..., name, source) plus what the source itself tells; sources are dropped."""
    names = [c for c in rows.columns if c != "source"]
    at, src = rows.columns.index("name"), rows.columns.index("source")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in _FACTS]
            for name, source in zip(b.column(at).to_pylist(), b.column(src).to_pylist()):
                s = source or ""
                hashed = bool(name) and name.lower().endswith((".py", ".pyi", ".sh", ".rb", ".yml", ".yaml"))
                syms, comments, literals, _ = tokens(s, hashed)
                one, two = rule_shares(syms)
                generated, upstream, owner = notices(comments)
                rules, sizes = global_rules(_written(s, hashed))
                row = (one, two, blob_share(syms, literals, len(s)), len(s) / (s.count("\n") + 1), generated, upstream, owner, rules.view(np.int64).tolist(), sizes.tolist())
                for c, v in zip(cols, row):
                    c.append(v)
            types = [pa.float64()] * 4 + [pa.bool_()] * 2 + [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32())]
            kept = [b.column(i) for i, c in enumerate(b.schema.names) if i != src]
            yield pa.RecordBatch.from_arrays([*kept, *[pa.array(c, t) for c, t in zip(cols, types)]], names=[*names, *[f.name for f in _FACTS]])

    return rows.mapInArrow(run, T.StructType([*[rows.schema[c] for c in names], *_FACTS]))


def judged(files: DataFrame, thirdparty: DataFrame) -> DataFrame:
    """(file_id, project, one column each evidence, generated, minified, third_party, data) of every row."""
    name = F.regexp_replace(F.coalesce(F.col("rel_path"), F.col("path")), r"\\", "/")
    both = F.concat_ws("\n", F.regexp_replace("rel_path", r"\\", "/"), F.regexp_replace("path", r"\\", "/"))
    own = files.select(F.monotonically_increasing_id().alias("row"), "file_id", "project", name.alias("name"), both.alias("paths"), "source")
    known = thirdparty.select(F.col("rel_path").alias("name"), "source").where(F.col("source").isNotNull())
    f = checkpoint(facts(spread(own)))  # read twice: its texts are lexed once
    # A rule of one or two tokens is shared by chance.
    theirs = facts(known).select(F.explode("rules").alias("rule"), F.lit(1).alias("known"), F.lit(0).alias("many")).distinct()
    uses = f.select("row", "project", F.explode(F.arrays_zip("rules", "sizes")).alias("r")).select("row", "project", F.col("r.rules").alias("rule"), F.col("r.sizes").alias("size"))
    of = F.coalesce("project", F.lit(""))
    many = uses.where(F.col("size") >= LONG_RULE).groupBy("rule").agg(F.min(of).alias("a"), F.max(of).alias("b")).where("a <> b").select("rule", F.lit(0).alias("known"), F.lit(1).alias("many"))
    named = theirs.unionByName(many).groupBy("rule").agg(F.max("known").alias("known"), F.max("many").alias("many"))
    size = uses.groupBy("row", "rule").agg(F.sum("size").alias("size"), F.max("size").alias("one"))
    tokens_of = lambda mark, least: F.sum(F.when((F.col(mark) == 1) & (F.col("one") >= least), F.col("size")).otherwise(0))
    share = lookup(size, named, ["rule"], "row").groupBy("row").agg((tokens_of("known", 5) / F.sum("size")).alias("copied"), tokens_of("many", LONG_RULE).alias("shared"), F.sum("size").alias("tokens"))
    libs = thirdparty.select(F.lower("lib").alias("owner")).where(F.col("owner").isNotNull()).distinct().withColumn("is_lib", F.lit(True))
    j = f.drop("rules", "sizes").join(share, "row", "left").join(libs, "owner", "left")
    where = lambda pattern: F.coalesce(F.exists(F.split("paths", "\n"), lambda p: p.rlike(pattern)), F.lit(False))
    evidence = {
        "repeated_rules": (F.col("one_rule") >= ONE_RULE) | (F.col("two_rules") >= TWO_RULES),
        "generated_notice": F.col("says_generated"),
        "generated_path": where(GENERATED_PATH),
        "long_lines": F.col("line") >= LINE,
        "minified_path": where(MINIFIED_PATH),
        "third_party_rules": F.coalesce("copied", F.lit(0.0)) >= COPY,
        "shared_rules": F.coalesce((F.col("shared") >= SHARED * F.col("tokens")) & (F.col("shared") >= SHARED_TOKENS), F.lit(False)),
        "upstream_notice": F.col("says_upstream"),
        "owner": F.coalesce("is_lib", F.lit(False)),
        "vendor_path": where(VENDOR_PATH),
        "incompressible": F.col("blob") >= BLOB,
    }
    rows = j.select("file_id", "project", *[e.alias(n) for n, e in evidence.items()])
    return rows.select("*", *[reduce(lambda a, b: a | b, map(F.col, names)).alias(kind) for kind, names in KINDS.items()])


#: What tells each kind; the first of each are grammars, the rest is what comments, paths and line ends declare.
KINDS = {
    "generated": ("repeated_rules", "generated_notice", "generated_path"),
    "minified": ("long_lines", "minified_path"),
    "third_party": ("third_party_rules", "shared_rules", "upstream_notice", "owner", "vendor_path"),
    "data": ("incompressible",),
}
GRAMMARS = ("repeated_rules", "third_party_rules", "shared_rules", "incompressible")


def evidence_counts(files: DataFrame, thirdparty: DataFrame) -> DataFrame:
    """(evidence, files, alone, beyond_grammars): distinct files that each evidence finds, that no other finds, and that no grammar finds."""
    names = [n for ns in KINDS.values() for n in ns]
    per = judged(files, thirdparty).groupBy("file_id").agg(*[F.max(n).alias(n) for n in names])
    hits = sum((F.col(n).cast("int") for n in names), F.lit(0))
    by_grammar = reduce(lambda a, b: a | b, map(F.col, GRAMMARS))
    one = per.select(hits.alias("hits"), by_grammar.alias("g"), F.explode(F.array_compact(F.array(*[F.when(F.col(n), F.lit(n)) for n in names]))).alias("evidence"))
    return one.groupBy("evidence").agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("hits") == 1).alias("alone"), F.count_if(~F.col("g")).alias("beyond_grammars"))


def not_handwritten(files: DataFrame, thirdparty: DataFrame) -> DataFrame:
    """(file_id, project, generated, minified, third_party, data) of distinct files for which any holds."""
    any_kind = reduce(lambda a, b: a | b, map(F.col, KINDS))
    return judged(files, thirdparty).where(any_kind).groupBy("file_id", "project").agg(*[F.max(k).alias(k) for k in KINDS])
