"""Small file formats: module files, coverage profiles, rules, desired states, knowledge graphs, git logs."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def go_mod(files: DataFrame) -> DataFrame:
    """(path, kind, module, version, indirect) of go.mod files (path, text): module, go, require and replace lines."""
    v = files.select("path", F.explode(F.split("text", r"\r?\n")).alias("v")).select("path", F.regexp_replace("v", r"^\s+|\s+$", "").alias("v"))
    req = r"^(?:require )?([\w.\-/~]+) (v[\w.\-+]+)(\s*// indirect)?"
    kind = F.when(F.col("v").startswith("module "), "module").when(F.col("v").rlike(r"^go \d"), "go").when(F.col("v").contains("=>"), "replace").when(F.col("v").rlike(req), "require")
    module = F.when(kind == "module", F.regexp_extract("v", r"^module (\S+)", 1)).when(kind == "replace", F.regexp_extract("v", r"^(?:replace )?(\S+)", 1)).when(kind == "require", F.regexp_extract("v", req, 1)).otherwise("")
    version = F.when(kind == "go", F.regexp_extract("v", r"^go (\S+)", 1)).when(kind == "replace", F.regexp_extract("v", r"=>\s*(.+)$", 1)).when(kind == "require", F.regexp_extract("v", req, 2)).otherwise("")
    return v.select("path", kind.alias("kind"), module.alias("module"), version.alias("version"), F.coalesce((kind == "require") & F.col("v").contains("// indirect"), F.lit(False)).alias("indirect")).where("kind IS NOT NULL")


def front_matter(files: DataFrame) -> DataFrame:
    """(path, description, globs, always, body) of rule and skill files with a --- header."""
    head = F.regexp_extract("text", r"(?s)^---\r?\n(.*?)\r?\n---", 1)
    field = lambda k: F.trim(F.regexp_extract(head, rf"(?m)^{k}:[ \t]*(.*)$", 1))
    globs = F.filter(F.split(F.regexp_replace(field("globs"), r"[\[\]\"']", ""), r"\s*,\s*"), lambda x: x != "")
    return files.select("path", field("description").alias("description"), globs.alias("globs"), (field("alwaysApply") == "true").alias("always"), F.regexp_replace(F.regexp_replace("text", r"(?s)^---\r?\n.*?\r?\n---\r?\n?", ""), r"^\s+|\s+$", "").alias("body"))


def desired_state(spark: SparkSession, text: str) -> tuple[DataFrame, DataFrame]:
    """(components, edges) of a desired architecture: JSON with both lists, or a Mermaid graph with id["label"] and a --> b."""
    if text.lstrip().startswith("{"):
        d = json.loads(text)
        names = [(c if isinstance(c, str) else c["name"],) for c in d.get("components", [])]
        pairs = [(e["from"], e["to"]) for e in d.get("edges", [])]
    else:
        label = dict(re.findall(r'(\w+)\["?([^"\]]+)"?\]', text))
        plain = re.sub(r'\["?[^\]]*\]', "", text)
        pairs = [(label.get(a, a), label.get(b, b)) for a, b in re.findall(r"(\w+)\s*-->\s*(?:\|[^|]*\|\s*)?(\w+)", plain)]
        names = [(x,) for x in dict.fromkeys([*label.values(), *[x for p in pairs for x in p]])]
    return spark.createDataFrame(names, "name string"), spark.createDataFrame(pairs, "src string, dst string")


def knowledge_graph(spark: SparkSession, text: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a knowledge graph in YAML: list items of flat keys, lists in square brackets, edges as flow maps."""
    nodes, edges, item = [], [], None
    for raw in text.splitlines():
        line = raw.rstrip()
        flow = re.match(r"\s*-\s*\{(.*)\}\s*$", line)
        if flow:
            kv = dict(re.split(r"\s*:\s*", x.strip(), maxsplit=1) for x in flow.group(1).split(","))
            edges.append((kv.get("from"), kv.get("to"), kv.get("kind"), float(kv.get("weight", 1))))
            continue
        m = re.match(r"\s*(-\s+)?(\w+):\s*(.*)$", line)
        if not m or (not m.group(1) and not line.startswith(" ")):
            continue
        if m.group(1):
            item = {}
            nodes.append(item)
        if item is not None:
            v = m.group(3).strip().strip('"')
            item[m.group(2)] = [x.strip() for x in v[1:-1].split(",") if x.strip()] if v.startswith("[") else v
    rows = [(n.get("id"), n.get("path"), n.get("kind"), n.get("keywords") or [], n.get("about")) for n in nodes]
    return spark.createDataFrame(rows, "id string, path string, kind string, keywords array<string>, about string"), spark.createDataFrame(edges, "`from` string, `to` string, kind string, weight double")


def git_log(lines: DataFrame) -> DataFrame:
    """(hash, author, date, message, file) of rows (value) in the form 'hash|author|ISO date|subject|file', malformed ones left out."""
    x = F.split("value", r"\|", 5)
    return lines.where(F.size(x) == 5).select(x[0].alias("hash"), x[1].alias("author"), F.to_timestamp_ntz(x[2]).alias("date"), x[3].alias("message"), x[4].alias("file")).where("hash <> '' AND file <> ''")


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """(file): paths that are new, gone or of another content hash (path, hash)."""
    j = before.select("path", F.col("hash").alias("b")).join(after.select("path", F.col("hash").alias("a")), "path", "full_outer")
    return j.where(~F.col("a").eqNullSafe(F.col("b"))).select(F.col("path").alias("file"))
