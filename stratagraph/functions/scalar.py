"""Column functions of the engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def fqn_of(package: Column | str, name: Column | str) -> Column:
    """package.name, or the bare name without a package."""
    p, n = _c(package), _c(name)
    return F.when(F.coalesce(p, F.lit("")) == "", n).otherwise(F.concat(p, F.lit("."), n))


def package_of(fqn: Column | str) -> Column:
    """What stands before the last dot; '' without a dot."""
    f = _c(fqn)
    return F.when(f.contains("."), F.regexp_replace(f, r"\.[^.]*$", "")).otherwise(F.lit(""))


def bare_name(fqn: Column | str) -> Column:
    return F.regexp_extract(_c(fqn), r"([^.]*)$", 1)


def dir_of(path: Column | str) -> Column:
    """Folder of a path; '' for files at the root."""
    p = _c(path)
    return F.when(p.contains("/"), F.regexp_replace(p, r"/[^/]*$", "")).otherwise(F.lit(""))


def base_of(path: Column | str) -> Column:
    return F.substring_index(_c(path), "/", -1)


def first_segments(path: Column | str, depth: int) -> Column:
    return F.substring_index(_c(path), "/", depth)


def short_path(path: Column | str, module: str) -> Column:
    """Import path without its module; the module itself is (root)."""
    p = _c(path)
    return F.when(p == module, F.lit("(root)")).when(p.startswith(module + "/"), F.substring(p, len(module) + 2, 1 << 30)).otherwise(p)


def instability(fan_in: Column, fan_out: Column) -> Column:
    return F.when(fan_in + fan_out > 0, fan_out / (fan_in + fan_out)).otherwise(F.lit(0.0))


def glob_regex(glob: str) -> str:
    """A path glob as a regular expression: * and ? stay within a segment, classes pass through."""
    import re

    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and "]" in glob[i + 1 :]:
            j = glob.index("]", i + 1)
            body = glob[i + 1 : j]
            out += "[" + ("^" + body[1:] if body[:1] in "!^" else body) + "]"
            i = j
        else:
            out += re.escape(c)
        i += 1
    return "^" + out + "$"


def matches_pattern(value: Column | str, pattern: str) -> Column:
    """Rule patterns: empty or * match all, then a path glob, then a substring."""
    v = _c(value)
    if pattern in ("", "*"):
        return F.lit(True)
    return v.rlike(glob_regex(pattern)) | v.contains(pattern)


def split_camel(name: Column | str) -> Column:
    """Words of a camel-case name; runs of capitals stay together."""
    marked = F.regexp_replace(_c(name), r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|_|-", "\u0001")
    return F.filter(F.split(marked, "\u0001"), lambda x: F.length(x) > 0)


def short_hash(x: Column | str) -> Column:
    """First 8 bytes of the SHA-256, in hex."""
    return F.substring(F.sha2(_c(x), 256), 1, 16)


def mermaid_id(name: Column | str) -> Column:
    return F.regexp_replace(_c(name), r"[ \-./()]", "_")


def percent(part: Column, whole: Column) -> Column:
    """Whole percent, cut off."""
    return F.when(whole > 0, F.floor(part * 100 / whole)).otherwise(F.lit(0)).cast("bigint")


def health(fan_in: Column, churn: Column) -> Column:
    return F.when((fan_in >= 5) & (churn >= 15), "fatal").when((fan_in >= 3) & (churn >= 8), "sick").otherwise("healthy")


def risk_level(blast: Column) -> Column:
    return F.when(blast >= 50, "critical").when(blast >= 25, "high").when(blast >= 10, "medium").otherwise("low")


def normalise_repo_url(url: Column | str) -> Column:
    """owner/name, scp-like and bare host forms as an https address without .git."""
    u = F.regexp_replace(F.trim(_c(url)), r"(\.git)?/*$", "")
    u = F.regexp_replace(u, r"^git@([^:]+):", "https://$1/")
    u = F.regexp_replace(u, r"^(ssh|git)://(git@)?", "https://")
    return F.when(u.rlike(r"^https?://"), u).when(u.rlike(r"^[\w-]+(\.[\w-]+)+/"), F.concat(F.lit("https://"), u)).when(u.rlike(r"^[\w.-]+/[\w.-]+$"), F.concat(F.lit("https://github.com/"), u)).otherwise(u)
