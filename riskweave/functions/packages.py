"""Package identity as Columns: normal names, look-up keys, and what imports may mean a package."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .columns import empty

EXACT, CANONICAL, ARTIFACT = "exact_package_match", "canonical_package_match", "artifact_alias_match"


def clean(name: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(F.coalesce(name, F.lit(""))), "^['\"]+|['\"]+$", ""))


def _eco(ecosystem: Column) -> Column:
    return F.lower(F.trim(F.coalesce(ecosystem, F.lit(""))))


def folds(ecosystem: Column) -> Column:
    return _eco(ecosystem).isin(fixed.FOLDING_ECOSYSTEMS)


def fold(name: Column, by: str = "-") -> Column:
    return F.regexp_replace(name, "[-_.]+", by)


def normal(name: Column, ecosystem: Column) -> Column:
    """The canonical form of a name in its ecosystem."""
    low = clean(name)
    group = F.concat_ws(":", F.trim(F.substring_index(low, ":", 1)), F.trim(F.regexp_replace(low, "(?s)^[^:]*:", "")))
    return F.when(folds(ecosystem), fold(low)).when((_eco(ecosystem) == "maven") & low.contains(":"), group).otherwise(low)


def artifact(name: Column, ecosystem: Column) -> Column:
    """The artifact of a Maven coordinate, else null."""
    low = clean(name)
    return F.when((_eco(ecosystem) == "maven") & low.contains(":"), F.trim(F.regexp_replace(low, "(?s)^[^:]*:", "")))


def _present(values: Column) -> Column:
    return F.array_distinct(F.filter(F.array_compact(values), lambda v: v != ""))


def _folded(low: Column) -> Column:
    return F.array(F.replace(low, F.lit("_"), F.lit("-")), F.replace(low, F.lit("-"), F.lit("_")), F.replace(low, F.lit("."), F.lit("-")), F.replace(low, F.lit("."), F.lit("_")), fold(low))


def index_keys(name: Column, ecosystem: Column) -> Column:
    """The keys under which an advisory's package is found."""
    low = clean(name)
    return _present(F.concat(F.array(low, normal(name, ecosystem)), F.when(folds(ecosystem), _folded(low)).otherwise(empty()), F.array(artifact(name, ecosystem))))


def lookup_keys(name: Column, ecosystem: Column) -> Column:
    """(key, match type) to try, in order; a key counts with its first type."""
    low, canon = clean(name), normal(name, ecosystem)
    kind = lambda k, t: F.struct(k.alias("key"), F.lit(t).alias("match_type"))
    maven = F.when(low.contains(":"), F.array(kind(canon, EXACT), kind(low, CANONICAL), kind(artifact(name, ecosystem), ARTIFACT))).otherwise(F.array(kind(low, ARTIFACT)))
    first = F.struct(low.alias("key"), F.when(low == canon, EXACT).otherwise(CANONICAL).alias("match_type"))
    folded = F.concat(F.array(first, kind(canon, CANONICAL)), F.transform(F.array_sort(index_keys(name, ecosystem)), lambda k: kind(k, CANONICAL)))
    plain = F.array(kind(canon, EXACT), kind(low, CANONICAL))
    pairs = F.when(_eco(ecosystem) == "maven", maven).when(folds(ecosystem), folded).otherwise(plain)
    pairs = F.filter(pairs, lambda p: F.coalesce(p["key"], F.lit("")) != "")
    names = F.transform(pairs, lambda p: p["key"])
    return F.filter(pairs, lambda p, i: F.array_position(names, p["key"]) == i + 1)


def import_aliases(name: Column, ecosystem: Column) -> Column:
    """Names under which source files may import a package."""
    low, canon, eco = clean(name), normal(name, ecosystem), _eco(ecosystem)
    curated = F.create_map(*[x for e, m in fixed.IMPORT_ALIASES.items() for k, v in m.items() for x in (F.lit(f"{e} {k}"), F.lit(v))])
    parts = F.filter(F.split(canon, "[-_./]+"), lambda p: p != "")
    per = (
        F.when(eco == "npm", F.array(F.replace(low, F.lit("-"), F.lit("_"))))
        .when(eco == "maven", F.when(low.contains(":"), F.array(F.trim(F.substring_index(low, ":", 1)), artifact(name, ecosystem))).otherwise(empty()))
        .otherwise(empty())
    )
    under = F.when(folds(ecosystem), F.array(F.replace(canon, F.lit("-"), F.lit("_")), F.replace(low, F.lit("-"), F.lit("_")))).otherwise(empty())
    pub = F.when(eco == "pub", F.array(F.concat(F.lit("package:"), canon, F.lit("/")), F.concat(F.lit("package:"), F.replace(canon, F.lit("-"), F.lit("_")), F.lit("/")))).otherwise(empty())
    hexes = F.when((eco == "hex") & (F.size(parts) > 0), F.array(F.array_join(parts, "."), F.array_join(parts, ""))).otherwise(empty())
    return F.when(low == "", empty()).otherwise(_present(F.concat(F.array(low, canon, F.try_element_at(curated, F.concat_ws(" ", eco, canon))), per, under, pub, hexes)))


def usage_tokens(name: Column, ecosystem: Column) -> Column:
    """What a text may call a package by: its aliases, and its name with _ or / for -."""
    low = clean(name)
    return _present(F.concat(import_aliases(name, ecosystem), F.array(low, F.replace(low, F.lit("-"), F.lit("_")), F.replace(low, F.lit("-"), F.lit("/")))))


def import_candidates(module: Column) -> Column:
    """A module and its prefixes at slashes and dots, each less specific."""
    low = clean(module)
    package = F.substring_index(F.regexp_replace(low, "^package:", ""), "/", 1)
    dart = F.when(low.startswith("package:"), F.array(package, F.concat(F.lit("package:"), package, F.lit("/")))).otherwise(empty())

    def prefixes(sep: str, pattern: str) -> Column:
        parts = F.filter(F.split(low, pattern), lambda p: p != "")
        made = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), sep))
        return F.when(low.contains(sep) & (F.size(parts) > 0), made).otherwise(empty())

    return F.when(low == "", empty()).otherwise(_present(F.concat(F.array(low), dart, prefixes("/", "/"), prefixes(".", r"\."))))


def import_reach(module: Column) -> Column:
    """All names by which ``import_match`` may take a module for a package: its candidates, and its beginnings
    before a slash or dot as they are written; those of a Dart import at any letter."""
    low = clean(module)
    ends = F.filter(F.sequence(F.lit(1), F.greatest(F.length(low), F.lit(1))), lambda i: low.startswith("package:") | F.substring(low, i + 1, F.lit(1)).isin("/", "."))
    return _present(F.concat(import_candidates(module), F.transform(ends, lambda i: F.substring(low, F.lit(1), i))))


def import_match(name: Column, ecosystem: Column, module: Column) -> Column:
    """(confidence, kind, alias): how likely an import means a package; null if it does not."""
    low, maven = clean(module), _eco(ecosystem) == "maven"
    candidates = import_candidates(module)

    def score(a: Column) -> Column:
        dotted = F.when(maven, 0.72).otherwise(0.9)
        out = F.when(low == a, 1.0).when(a.startswith("package:") & low.startswith(a), 0.98).when(low.startswith(F.concat(a, F.lit("/"))), 0.95)
        return out.when(low.startswith(F.concat(a, F.lit("."))), dotted).when(F.array_contains(candidates, a), 0.82).otherwise(0.0)

    # of equal scores the first alias in alphabetical order
    scored = F.array_sort(F.transform(import_aliases(name, ecosystem), lambda a: F.struct((-score(a)).alias("s"), a.alias("alias"))))
    best = F.try_element_at(scored, F.lit(1))
    value = -best["s"]
    found = F.struct(value.alias("confidence"), F.when(value >= 0.85, "import").otherwise("reference").alias("kind"), best["alias"].alias("alias"))
    return F.when((low != "") & (value > 0), found)


def keys_overlap(a: Column, b: Column, ecosystem: Column) -> Column:
    """May two names mean one package?"""
    return F.arrays_overlap(index_keys(a, ecosystem), index_keys(b, ecosystem)) | (normal(a, ecosystem) == normal(b, ecosystem))


def function_keys(symbol: Column) -> Column:
    """Index keys of a vulnerable function: identifiers of its qualified name, without arguments
    and type parameters."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(symbol), r"(?s)\(.*$", ""), r"<[^>]*>", "")
    parts = F.split(F.regexp_replace(bare, r"::|->|#|/", "."), r"\.")
    return F.array_distinct(F.transform(F.filter(parts, lambda p: (F.length(p) >= 2) & p.rlike("^[A-Za-z_$][A-Za-z0-9_$]*[!?]?$")), lambda p: F.lower(p)))


def clean_version(version: Column) -> Column:
    """A version as manifests write it, without operators and protocols; empty for local sources."""
    v = F.regexp_replace(F.trim(F.coalesce(version, F.lit(""))), "^['\"]+|['\"]+$", "")
    local = v.rlike("^(workspace:|file:|link:|git\\+|github:|path:)")
    alias = F.regexp_replace(v, "^npm:(?:.*@)?", "")
    bare = F.regexp_replace(F.regexp_replace(F.trim(F.substring_index(F.when(v.startswith("npm:"), alias).otherwise(v), "||", 1)), "^[\\^~<>=! ]+", ""), "^v+", "")
    return F.when(local, "").otherwise(F.trim(bare))
