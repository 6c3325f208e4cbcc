"""What advisories and their patches say about vulnerable symbols, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import any_of, empty, let

# What in an advisory's text names a function, and what only looks like one.
INLINE_CODE = r"`([^`\n]{2,160})`"
FUNCTION_CONTEXT = r"(?i)(?:function|method|api|endpoint|helper|callback|constructor)\s+(?:called\s+|named\s+)?`?([A-Za-z_][A-Za-z0-9_:.-]{1,120}(?:\(\))?)`?"
FILE_LIKE = r"(?i)\.(?:js|ts|tsx|jsx|py|go|java|c|cc|cpp|h|hpp|rb|php|rs|md|json|yaml|yml|toml|ini|html|css|scss|exs|txt)$"
ENV_LIKE = r"^[A-Z][A-Z0-9_]{2,}$"
HEADER_LIKE = r"^[A-Z][A-Za-z0-9-]+(?:-[A-Z][A-Za-z0-9-]+)+$"
VERSION_LIKE = r"^v?\d+(?:\.\d+)+(?:[-+][A-Za-z0-9_.-]+)?$"
SYMBOL_LIKE = r"^[A-Za-z_][A-Za-z0-9_:.-]*$"
GENERIC_NAMES = ["main", "new", "default", "test", "example", "read", "write", "open", "close", "call", "run", "exec"]
NEAR_WORDS = ["function", "method", "api", "endpoint", "helper", "callback"]

# References to patches, and paths of patches that say nothing.
COMMIT = r"^https://github\.com/[^/]+/[^/]+/commit/[A-Fa-f0-9]+/?$"
COMPARE = r"^https://github\.com/[^/]+/[^/]+/compare/.+$"
PULL = r"^https://github\.com/[^/]+/[^/]+/pull/\d+/?$"
PATCH_SKIP_DIRS = [".github", "__mocks__", "__tests__", "benchmark", "benchmarks", "changelog", "ci", "doc", "docs", "example", "examples", "news", "release", "releases", "scripts", "spec", "specs", "test", "tests"]
PATCH_SKIP_FILE = r"(?i)(?:^|[\\/])(?:(?:test|spec)\.(?:js|jsx|ts|tsx|mjs|cjs|py)|[^\\/]+\.(?:spec|test)\.(?:js|jsx|ts|tsx|mjs|cjs|py))$"

#: Code points before and after inline code in which a word may tell that it is a function.
NEAR = 40


def candidate(token: Column, explicit: Column) -> Column:
    """A token as a function's name; null where it is none. explicit: something else says it is one."""
    bare = F.regexp_replace(F.trim(F.coalesce(token, F.lit(""))), "^[`'\"]+|[`'\"]+$", "")
    name = lambda bare: F.regexp_replace(F.trim(F.regexp_replace(F.trim(F.substring_index(bare, "(", 1)), "<[^>]+>", "")), "[).,:;]+$", "")

    def judged(bare, name):
        wrong = (bare == "") | bare.rlike(r"\s") | (name == "") | F.lower(name).isin(GENERIC_NAMES) | name.contains("/")
        wrong = wrong | any_of([name.rlike(p) for p in (VERSION_LIKE, FILE_LIKE, ENV_LIKE, HEADER_LIKE)]) | ~name.rlike(SYMBOL_LIKE)
        qualified = any_of([name.contains(s) for s in ("::", ".", "->", "#")])
        return F.when(~wrong & (explicit | qualified | bare.contains("(") | name.contains("_") | F.substring(name, 2, 10**6).rlike("[A-Z]")), name)

    return let(bare, lambda b: let(name(b), lambda n: judged(b, n)))


def _places(text: Column, pattern: str) -> Column:
    """(start, end, value) of a pattern's matches, counted from 0; value is group 1."""
    pattern_ = F.lit(pattern)
    parts = F.struct(F.regexp_extract_all(text, pattern_, F.lit(0)).alias("found"), F.regexp_extract_all(text, pattern_, F.lit(1)).alias("values"), F.split(text, pattern, -1).alias("gaps"))
    size = lambda a, n: F.length(F.array_join(F.slice(a, F.lit(1), n), ""))

    def place(p, m, i):
        start = size(p["gaps"], i + 1) + size(p["found"], i)
        return let(start, lambda s: F.struct(s.alias("start"), (s + F.length(m)).alias("end"), F.get(p["values"], i).alias("value")))

    return let(parts, lambda p: F.transform(p["found"], lambda m, i: place(p, m, i)))


def text_symbols(text: Column, field: str) -> Column:
    """(symbol, source) of the functions that a text names: after a word for one, or as inline code,
    which counts as named where such a word is near."""
    text = F.coalesce(text, F.lit(""))
    of = lambda name, source: F.struct(name.alias("symbol"), F.lit(f"{field}_{source}").alias("source"))
    context = F.transform(F.regexp_extract_all(text, F.lit(FUNCTION_CONTEXT), F.lit(1)), lambda t: of(candidate(t, F.lit(False)), "context"))

    def inline(p):
        first = F.greatest(p["start"] - NEAR, F.lit(0))
        window = F.lower(F.substring(text, first + 1, p["end"] + NEAR - first))
        return let(window, lambda w: of(candidate(p["value"], any_of([w.contains(x) for x in NEAR_WORDS])), "inline_code"))

    return F.array_distinct(F.filter(F.concat(context, F.transform(_places(text, INLINE_CODE), inline)), lambda s: s["symbol"].isNotNull()))


def symbol_confidence(sources: Column) -> Column:
    said = F.array_join(sources, " ")
    return F.when(said.contains("ecosystem_specific"), 1.0).when(said.contains("context"), 0.7).otherwise(0.45)


def import_path(value: Column) -> Column:
    """A module's path as an advisory writes it; null for blanks and addresses."""
    bare = F.regexp_replace(F.trim(F.coalesce(value, F.lit(""))), "^[`'\"]+|[`'\"]+$", "")
    return F.when(~bare.rlike(r"\s|^https?://"), F.nullif(F.regexp_replace(bare, "[).,:;]+$", ""), F.lit("")))


def patch_urls(references: Column, limit: int = 1) -> Column:
    """Addresses of patches behind references: of commits first, then of comparisons and pull
    requests, each once."""
    trimmed = F.transform(F.coalesce(references, empty()), lambda r: F.trim(r))
    of = lambda p: F.filter(trimmed, lambda r: r.rlike(p))
    url = lambda a: F.transform(a, lambda r: F.concat(F.regexp_replace(r, "/+$", ""), F.lit(".patch")))
    return F.slice(F.array_distinct(F.concat(*[url(of(p)) for p in (COMMIT, COMPARE, PULL)])), 1, limit)


def _in_repo(path: Column) -> Column:
    return F.regexp_replace(F.trim(F.coalesce(path, F.lit(""))), "^[ab]/", "")


def skipped_in_patches(path: Column) -> Column:
    """Is a patched file a test, a document or a script, so that its symbols say nothing?"""
    clean = _in_repo(path)
    parts = F.transform(F.filter(F.split(clean, "/"), lambda p: p != ""), lambda p: F.lower(p))
    return (clean == "") | (clean == "/dev/null") | clean.rlike(PATCH_SKIP_FILE) | clean.rlike(r"\.py[ic]$") | F.exists(parts, lambda p: p.isin(PATCH_SKIP_DIRS) | p.rlike("(?:^|[-_])(spec|specs|test|tests)$"))


def python_module(path: Column) -> Column:
    """The Python module of a patched file; null where it has none."""
    parts = F.filter(F.split(_in_repo(path), "/"), lambda p: ~p.isin("", "."))
    inner = F.when(F.get(parts, 0).isin("src", "lib", "python"), F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    file = F.try_element_at(inner, F.lit(-1))
    home = F.slice(inner, F.lit(1), F.greatest(F.size(inner) - 1, F.lit(0)))
    names = F.when(file == "__init__.py", home).otherwise(F.array_append(home, F.regexp_replace(file, r"\.py$", "")))
    good = ~skipped_in_patches(path) & _in_repo(path).endswith(".py") & (F.size(names) > 0) & F.forall(names, lambda n: n.rlike("^[A-Za-z_][A-Za-z0-9_]*$"))
    return F.when(good, F.array_join(names, "."))


def npm_modules(path: Column, package: Column) -> Column:
    """Modules of an npm package by which a patched file may be imported: with and without the
    directory of sources."""
    parts = F.filter(F.split(_in_repo(path), "/"), lambda p: ~p.isin("", "."))
    own = F.when((F.get(parts, 0) == "packages") & (F.size(parts) >= 3), F.slice(parts, F.lit(3), F.greatest(F.size(parts) - 2, F.lit(0)))).otherwise(parts)
    stem = F.regexp_replace(F.try_element_at(own, F.lit(-1)), r"(?<=.)\.[^.]*$", "")
    home = F.slice(own, F.lit(1), F.greatest(F.size(own) - 1, F.lit(0)))
    shorter = F.when(F.get(own, 0).isin("src", "lib", "dist", "app"), F.slice(home, F.lit(2), F.greatest(F.size(home) - 1, F.lit(0)))).otherwise(home)
    name = lambda a: F.array_join(F.when(stem == "index", a).otherwise(F.array_append(a, stem)), "/")
    under = lambda p: F.when(p != "", F.concat(package, F.lit("/"), p))
    made = F.array(F.when((name(home) == "") & (package != ""), package), under(name(home)), under(name(shorter)))
    code = ~skipped_in_patches(path) & _in_repo(path).rlike(r"\.(?:js|mjs|cjs|ts|tsx|jsx)$")
    return F.when(code, F.array_distinct(F.array_compact(made))).otherwise(empty())
