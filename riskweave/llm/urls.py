"""URL filter: rules by host and path, then a list of canonical URLs behind a blocked Bloom filter.

The longest rule that fits a URL decides. Where none fits, the URL is blocked if one of its
canonical forms (a suffix of its host with a prefix of its path that ends at a slash, or the whole
path) is listed. The list's blocked Bloom filter (64-bit blocks, three bits for each form) is
broadcast: it has at most 2**MOST_BLOCKS rows whatever the list's size. Forms that it passes meet
the list in an exact hash join, which removes false positives. Each distinct URL and form is probed
once; a form that very many URLs have, or a URL that very many rows have, is dealt over SALTS keys,
against which the list, or the hits, are repeated. Only rows that no rule decides are joined.

Defined cases: a null URL, or one without ``://``, has empty host and path; no rule fits it and no
listed form does, so it is allowed. An empty path counts as ``/`` for listed forms, not for rules.
Of rules of one length that fit, the last in the alphabet decides. Repeated rows each give a row; an empty list blocks nothing. All input columns stay, but those
named like an output (``host``, ``path``, ``rule``, ``verdict``) are replaced; inner columns take names
that are free.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

MOST_BLOCKS, FORMS_PER_BLOCK, SALTS = 20, 4, 32
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OUTPUTS = ("host", "path", "rule", "verdict")


def _rest(url: Column) -> Column:
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), "^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, from (allow or block, host, path) rules."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def forms(host: Column, path: Column, labels: int, depth: int) -> Column:
    """Canonical forms of a URL, of at most so many labels and path segments; none is missed
    when those are the most that any listed form has."""
    parts = F.split(host, r"\.")
    first = F.greatest(F.lit(1), F.size(parts) - labels + 1)
    hosts = F.when(host != "", F.transform(F.sequence(first, F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))).otherwise(F.array().cast("array<string>"))
    whole = F.when(path == "", "/").otherwise(path)
    segments = F.slice(F.split(whole, "/"), 1, depth + 1)
    full = F.size(F.split(whole, "/"))
    prefixes = F.transform(F.sequence(F.lit(1), F.least(F.lit(depth), full - 1)), lambda i: F.concat(F.array_join(F.slice(segments, 1, i), "/"), F.lit("/")))
    both = F.when(full <= depth + 1, F.array_append(prefixes, whole)).otherwise(prefixes)
    return F.array_distinct(F.flatten(F.transform(hosts, lambda h: F.transform(both, lambda p: F.concat(h, p)))))


def _mask(h: Column) -> Column:
    bit = lambda s: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(h, s).bitwiseAND(63).cast("int"))
    return bit(40).bitwiseOR(bit(47)).bitwiseOR(bit(54))


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, bits) of the forms in column form."""
    h = F.xxhash64("form")
    return listed.groupBy(F.pmod(h, F.lit(blocks)).alias("block")).agg(F.bit_or(_mask(h)).alias("bits"))


def possible(candidates: DataFrame, listed: DataFrame, blocks: int) -> DataFrame:
    """The candidates (with a column form) that the Bloom filter passes."""
    h = F.xxhash64("form")
    probe = candidates.withColumn("block", F.pmod(h, F.lit(blocks))).withColumn("mask", _mask(h))
    seen = probe.join(F.broadcast(bloom(listed, blocks)), "block").where(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"))
    return seen.drop("block", "mask", "bits")


def listed_forms(listed: DataFrame, column: str) -> DataFrame:
    """Distinct non-empty canonical forms (host in lower case, with a path)."""
    raw = F.trim(F.col(column))
    host, path = F.translate(F.substring_index(raw, "/", 1), UPPER, LOWER), F.regexp_extract(raw, "^[^/]*(/[^?#]*)", 1)
    return listed.select(F.concat(host, F.when(path == "", "/").otherwise(path)).alias("form")).where("form is not null and form <> '/'").distinct()


def salted(df: DataFrame, key: str, *more: str) -> DataFrame:
    """The rows once for each salt, for a merge join: the plan's size of them is that before they are
    repeated, by which they would be broadcast."""
    return df.select(key, *more, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")).hint("merge")


def judge(df: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]], url_col: str = "url", listed_col: str = "form") -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` and ``verdict``."""
    df = df.drop(*[c for c in df.columns if c.lower() in OUTPUTS and c != url_col])
    listed = listed_forms(listed, listed_col)
    size = listed.agg(F.count("*").alias("n"), F.max(F.size(F.split(F.substring_index("form", "/", 1), r"\."))).alias("labels"), F.max(F.size(F.split("form", "/")) - 1).alias("depth")).first()
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    df = df.withColumn("host", host_of(F.col(url_col))).withColumn("path", path_of(F.col(url_col)))
    df = df.withColumn("rule", rule).withColumn("verdict", verdict)
    if not size.n:
        return df.withColumn("verdict", F.coalesce("verdict", F.lit("allow")))
    blocks = min(1 << MOST_BLOCKS, 1 << max(6, (size.n // FORMS_PER_BLOCK).bit_length()))
    open_urls = df.where("rule is null and host <> ''").select(F.col(url_col).alias("url"), "host", "path").distinct()
    probes = open_urls.select("url", F.explode(forms(F.col("host"), F.col("path"), size.labels, size.depth)).alias("form"))
    probes = possible(probes, listed, blocks).withColumn("salt", F.pmod(F.xxhash64("url"), F.lit(SALTS)).cast("int"))
    hits = probes.join(salted(listed, "form"), ["form", "salt"], "left_semi").select("url").distinct()
    link, salt, hit = common.free(df, "link", "salt", "hit")
    # rows that a rule decides, and null URLs, need no partner: each goes where its own number says
    row = F.monotonically_increasing_id()
    out = df.withColumn(salt, F.pmod(row, F.lit(SALTS)).cast("int"))
    out = out.withColumn(link, F.when(F.col("rule").isNull() & (F.col("host") != ""), F.col(url_col)).otherwise(F.concat(F.lit("\n"), row.cast("string"))))
    own = salted(hits, "url").select(F.col("url").alias(link), F.col("salt").alias(salt), F.lit(True).alias(hit)).hint("merge")
    out = out.join(own, [link, salt], "left")
    method = F.when(F.col(hit), "block").otherwise("allow")
    return out.select(*[c for c in df.columns if c != "verdict"], F.coalesce("verdict", method).alias("verdict"))
