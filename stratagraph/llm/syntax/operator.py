"""Files that do not parse in the language of their name (problem 1).

1. Every source is lexed into rows (row, tok), in the task that reads it.
2. Adjacent pairs: each token is paired with the one before it, and the pairs are anti-joined with the pairs that the
   language's grammar permits. What is left makes its unit stray, which only a group of any tokens (a macro's arguments) may be.
3. Nesting: the running depth over a file's tokens gives each bracket its level; within one level, openers and
   closers must alternate and fit, which the preceding bracket of the level tells.
4. Productions: within a level, the tokens between two statement ends are reduced to one unit, with every bracket group
   below as a single symbol; the units of a file are matched top down against the productions of their contexts.

All windows share one exchange by file; a file's tokens were one record before, so no group is larger than a file. A token is one
number (position, symbol, flags), so that exchange and sorts move few bytes a token.

Defined cases: null sources are no case; the language follows from the extension of rel_path, or of path where rel_path
is null, in any case of letters; other extensions are no case; empty sources are valid but for Go, which needs a
package clause; repeated rows and re-scans give one result row; very long files and deep nesting are read whole; null ids give a
null id; empty tables are allowed; extra columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ...runtime import spread
from .engine import CLOSE, END, OPEN, START, WILD
from .grammars import LANGUAGES, grammar
from .lexers import ERR, lex, symbols
from .lexers import LANGUAGES as EXTENSIONS

#: Numbers of the symbols: openers, then closers in the same order, then all others. Four bits are left for flags, sixteen for symbols.
SYMBOLS = [*OPEN.values(), *CLOSE.values(), END, START, ERR]
SYMBOLS += sorted(set().union(*map(symbols, LANGUAGES), *({t for p in grammar(x).pairs() for t in p} for x in LANGUAGES)) - set(SYMBOLS))
CODE = {s: i for i, s in enumerate(SYMBOLS)}
_N = len(OPEN)
_SEP, _STRAY = 1, 2


def languages_of(files: DataFrame) -> DataFrame:
    """(row, file_id, project, lang, source) of the files that a language is known for."""
    name = F.coalesce(F.col("rel_path"), F.col("path"))
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)\s*$", 1))
    lang = F.create_map(*[x for e, lang in EXTENSIONS.items() for x in (F.lit(e), F.lit(LANGUAGES.index(lang)))])[ext]
    return files.select(F.monotonically_increasing_id().alias("row"), "file_id", "project", lang.cast("byte").alias("lang"), "source").where(F.col("lang").isNotNull() & F.col("source").isNotNull())


def tokens(files: DataFrame) -> DataFrame:
    """Token rows (row, tok, pair, file) of files (row, file_id, project, lang, source).

    tok is position, symbol and flags; pair the language, the symbol before and the symbol. The end of the file is a row of its
    own, which alone carries file (file_id, project, lang): nothing has to be joined by the row's number.
    """
    files = spread(files.select("row", "lang", "source", "file_id", "project"))
    file = T.StructType([files.schema[c] for c in ("file_id", "project", "lang")])
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("tok", T.LongType()), T.StructField("pair", T.LongType()), T.StructField("file", file)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.struct([(c, batch.column(c).type) for c in ("file_id", "project", "lang")])]
            cols: list[list] = [[] for _ in kinds]

            def flush():
                out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[f.name for f in schema])  # noqa: B023
                for c in cols:  # noqa: B023
                    c.clear()
                return out

            for row, lang, source, file_id, project in zip(*[c.to_pylist() for c in batch.columns]):
                toks = lex(LANGUAGES[lang], source)
                codes = [*[CODE[t[0]] for t in toks], CODE[END]]
                n = len(codes)
                cols[0] += [row] * n
                cols[1] += [p << 20 | c << 4 | t[2] for p, (c, t) in enumerate(zip(codes, toks))]
                cols[1].append((n - 1) << 20 | CODE[END] << 4)
                cols[2] += [lang << 32 | a << 16 | b for a, b in zip([CODE[START], *codes], codes)]
                cols[3] += [None] * (n - 1)
                cols[3].append({"file_id": file_id, "project": project, "lang": lang})
                if len(cols[0]) > 50_000:
                    yield flush()
            if cols[0]:
                yield flush()

    return files.mapInArrow(run, schema)


def permissible_pairs(spark: SparkSession) -> DataFrame:
    """(pair): a few thousand rows, fixed by the grammars."""
    rows = [i << 32 | CODE[a] << 16 | CODE[b] for i, lang in enumerate(LANGUAGES) for a, b in sorted(grammar(lang).pairs())]
    return spark.createDataFrame(pd.DataFrame({"pair": rows}), "pair bigint")


def _fits(lang: int, units: list[dict], known: dict) -> bool:
    """Whether the units of a file are productions, from the top down."""
    g = grammar(LANGUAGES[lang])
    groups: dict[int, list[dict]] = {}
    for u in sorted(units, key=lambda u: (u["grp"], u["unit"])):
        groups.setdefault(u["grp"], []).append(u)
    todo = [(-1, g.root)]
    while todo:
        at, ctx = todo.pop()
        for k, u in enumerate(groups.get(at) or [{"stray": False, "toks": []}]):
            c = g.first if at < 0 and k == 0 else ctx
            if u["stray"] and c != WILD:
                return False
            codes = [t >> 4 & 0xFFFF for t in u["toks"]]
            key = (lang, c, tuple(codes)) if len(codes) <= 64 else None
            got = known.get(key, 0) if key else 0
            if got == 0:
                got = g.match(c, [SYMBOLS[x] for x in codes])
                if key:
                    if len(known) > 50_000:
                        known.clear()
                    known[key] = got
            if got is None:
                return False
            todo += [(u["toks"][i] >> 20, x) for i, x in got]
    return True


def flagged(toks: DataFrame) -> DataFrame:
    """(file_id, project, lang) of files that break one of the three rules, from their token rows."""
    # The anti-join with the permissible pairs, as an outer join: what it misses stays with its file, and tokens are read once.
    pairs = F.broadcast(permissible_pairs(toks.sparkSession).withColumn("known", F.lit(True)))
    toks = toks.join(pairs, "pair", "left").withColumn("tok", F.col("tok").bitwiseOR(F.when(F.col("known").isNull(), F.lit(_STRAY)).otherwise(F.lit(0))))
    symbol = F.shiftright("tok", 4).bitwiseAND(F.lit(0xFFFF)).cast("int")
    toks = toks.select("row", "tok", "file")
    d = F.when(symbol < _N, 1).when(symbol < 2 * _N, -1).otherwise(0)
    by_pos = Window.partitionBy("row").orderBy("tok")
    depth = F.sum(d).over(by_pos.rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    leveled = toks.withColumn("depth", depth)
    # An opener stands as a symbol in the group around it and opens the level of the group below.
    at = lambda level, edge: F.struct(level.alias("level"), F.lit(edge).alias("edge"))
    levels = F.explode(F.when(d > 0, F.array(at(F.col("depth") - 1, 0), at(F.col("depth"), 1))).when(d < 0, F.array(at(F.col("depth") + 1, -1))).otherwise(F.array(at(F.col("depth"), 0))))
    rows = leveled.select("row", "tok", "file", levels.alias("l")).select("row", "tok", "file", "l.level", "l.edge", symbol.alias("sym"))
    at_level = Window.partitionBy("row", "level").orderBy("tok", F.col("edge"))
    before = at_level.rowsBetween(Window.unboundedPreceding, -1)
    is_edge = F.col("edge") != 0
    last_edge = F.last(F.when(is_edge, F.col("edge") * 100 + F.col("sym")), ignorenulls=True).over(before)  # openers over 0, closers below
    opened = F.last(F.when(F.col("edge") > 0, F.shiftright("tok", 20)), ignorenulls=True).over(at_level.rowsBetween(Window.unboundedPreceding, 0))
    # A unit ends after a separator; the edges end one as well.
    unit = F.coalesce(F.sum(F.when(is_edge | (F.col("tok").bitwiseAND(F.lit(_SEP)) != 0), 1).otherwise(0)).over(before), F.lit(0)).cast("int")
    rows = rows.withColumns({"last_edge": last_edge, "grp": opened.cast("int"), "unit": unit})
    misfit = (
        F.when(F.col("edge") > 0, F.coalesce(F.col("last_edge") >= 100, F.lit(False)))
        .when(F.col("edge") < 0, F.coalesce(F.col("last_edge") != F.col("sym") - _N + 100, F.lit(True)))
        .otherwise((F.col("sym") == CODE[END]) & (F.col("level") != 0))
    )
    ends = F.col("sym") == CODE[END]
    units = rows.groupBy("row", "level", "unit").agg(
        F.max(misfit).alias("misfit"),
        F.max((F.col("edge") <= 0) & (F.col("tok").bitwiseAND(F.lit(_STRAY)) != 0)).alias("stray"),  # an opener's pair belongs around it
        F.max(F.when(F.col("edge") <= 0, F.coalesce("grp", F.lit(-1)))).alias("grp"),
        F.sort_array(F.collect_list(F.when(~is_edge & ~ends, F.col("tok")))).alias("toks"),
        F.max("file").alias("file"),
    )
    # The last row of a file stands in a unit of its own level; a unit without tokens says nothing but that its pairs are stray.
    u = F.when((F.size("toks") > 0) | F.col("stray"), F.struct(F.coalesce("grp", F.lit(-1)).alias("grp"), "unit", "stray", "toks"))
    per_file = units.withColumn("u", u).groupBy("row").agg(F.max("misfit").alias("misfit"), F.collect_list("u").alias("units"), F.max("file").alias("file"))
    # Files with a misfit bracket go through without their units; they need no match.
    slim = per_file.select("file.*", "misfit", F.when(~F.col("misfit"), F.col("units")).alias("units"))
    schema = T.StructType([slim.schema["file_id"], slim.schema["project"], slim.schema["lang"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, tuple | None] = {}
        for batch in batches:
            langs, misfits = batch.column("lang").to_pylist(), batch.column("misfit").to_pylist()
            bad = [i for i, (lang, m, units) in enumerate(zip(langs, misfits, batch.column("units"))) if m or not _fits(lang, units.as_py(), seen)]
            yield batch.select(["file_id", "project", "lang"]).take(pa.array(bad, pa.int32()))

    return slim.mapInArrow(run, schema)


def unparsable(files: DataFrame) -> DataFrame:
    """(file_id, project, lang) of distinct files that do not parse; lang is an index of ``LANGUAGES``."""
    return flagged(tokens(languages_of(files))).distinct()


def rates(files: DataFrame, projects: DataFrame) -> DataFrame:
    """(project, language, files, unparsable, share): distinct files with a source, per project and its language; both rolled up (null project)."""
    total = files.where(F.col("source").isNotNull()).select("file_id", "project").distinct()
    bad = unparsable(files).select("file_id", F.lit(1).alias("bad")).distinct()
    lang = projects.select(F.col("path").alias("project"), "language")
    one = total.join(bad, "file_id", "left").join(lang, "project", "left")
    out = one.groupBy("project", "language").agg(F.count(F.lit(1)).alias("files"), F.sum(F.coalesce("bad", F.lit(0))).alias("unparsable"))
    by_lang = out.groupBy("language").agg(F.sum("files").alias("files"), F.sum("unparsable").alias("unparsable")).select(F.lit(None).cast("string").alias("project"), "language", "files", "unparsable")
    return out.unionByName(by_lang).withColumn("share", F.col("unparsable") / F.col("files"))
