"""Path predicates and normal forms as Columns; paths have forward slashes inside the engine."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .columns import any_of


def normalise(path: Column) -> Column:
    """Forward slashes, none at either end, no leading ``./``."""
    return F.regexp_replace(F.regexp_replace(F.translate(path, "\\", "/"), "^/+|/+$", ""), r"^\./", "")


def name(path: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)


def extension(path: Column) -> Column:
    """The last suffix in lower case; a dotfile has none."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*(\.[^./]+)$", 1))


def is_binary(path: Column) -> Column:
    return extension(path).isin(fixed.BINARY_EXTENSIONS)


def glob_regex(pattern: str) -> str:
    """A glob as a regular expression: a relative pattern is matched at the right end."""
    body = "".join("[^/]*" if p == "*" else "[^/]" if p == "?" else p if p.startswith("[") else re.escape(p) for p in re.findall(r"\*+|\?|\[[^\]]*\]|.", pattern.replace("**", "*")))
    return ("^" if pattern.startswith("/") else "(?:^|/)") + body + "$"


def skipped(path: Column, prefixes: list[str] = (), globs: list[str] = ()) -> Column:
    """Is a path under a skipped directory, an ignored prefix, or matched by an ignored glob?"""
    rel = normalise(path)
    under = [(rel == p) | rel.startswith(p + "/") for p in prefixes]
    return F.arrays_overlap(F.split(rel, "/"), F.array(*[F.lit(d) for d in fixed.SKIP_DIRS])) | any_of(under) | any_of([rel.rlike(glob_regex(g)) for g in globs])


def is_safe(path: Column) -> Column:
    """Does a relative path stay below its root, once ``..`` is resolved?"""
    parts = F.filter(F.split(F.translate(path, "\\", "/"), "/"), lambda p: ~p.isin("", "."))
    state = F.struct(F.lit(0).alias("depth"), F.lit(True).alias("ok"))

    def step(s, p):
        depth = s["depth"] + F.when(p == "..", -1).otherwise(1)
        return F.struct(depth.alias("depth"), (s["ok"] & (depth >= 0)).alias("ok"))

    return ~path.startswith("/") & F.aggregate(parts, state, step, lambda s: s["ok"])


def _lowered(path: Column) -> Column:
    return F.lower(F.trim(F.translate(F.coalesce(path, F.lit("")), "\\", "/")))


def reviewable(path: Column) -> Column:
    """Files that are no code but are reviewed: manifests, configuration, templates."""
    low = _lowered(path)
    base = name(low)
    env = base.startswith(".env") & ~base.isin(".env.example", ".env.sample")
    return (low != "") & (base.isin(fixed.REVIEWABLE_NAMES) | env | extension(low).isin(fixed.REVIEWABLE_EXTENSIONS))


def investigated(path: Column) -> Column:
    """Does a file deserve a deep look? Reviewable ones first, then what is not excluded."""
    low = _lowered(path)
    out = name(low).isin(fixed.SKIP_NAMES) | extension(low).isin(fixed.SKIP_EXTENSIONS) | any_of([low.endswith(s) for s in fixed.SKIP_SUFFIXES])
    return (low != "") & (reviewable(path) | ~out)


def in_tests(path: Column) -> Column:
    """The strict test predicate: by segment and by file name."""
    low = F.lower(F.translate(path, "\\", "/"))
    parts = F.filter(F.split(low, "/"), lambda p: p != "")
    file = F.coalesce(F.try_element_at(parts, F.lit(-1)), low)
    by_dir = F.arrays_overlap(parts, F.array(*[F.lit(x) for x in ("test", "tests", "__tests__")]))
    return by_dir | any_of([file.endswith(s) for s in fixed.TEST_SUFFIXES]) | file.startswith("test_")


def indexed_as_test(path: Column) -> Column:
    """The loose test predicate of the file index: any mention counts."""
    return F.lower(path).rlike("test|spec|__test__|fixture|mock")


def same_directory(a: Column, b: Column) -> Column:
    """Equal parent directories; files at the root are unrelated."""
    parent = lambda p: F.regexp_extract(F.translate(p, "\\", "/"), "^(.*)/[^/]*$", 1)
    return (parent(a) != "") & (parent(a) == parent(b))


def low_context(path: Column) -> Column:
    """Is a file a test, an example or a document?"""
    low = F.concat(F.lit("/"), F.lower(normalise(F.coalesce(path, F.lit("")))))
    return F.exists(F.array(*[F.lit(m) for m in fixed.LOW_CONTEXT]), lambda m: low.contains(m))


def declaring_manifest(path: Column) -> Column:
    """The manifest beside a lockfile; null for other files."""
    beside = F.try_element_at(F.create_map(*[F.lit(x) for pair in fixed.DECLARED_IN.items() for x in pair]), name(path))
    return F.concat(F.regexp_extract(path, "^(.*/)?[^/]*$", 1), beside)
