"""Rule corpora of scanners: reading them, and choosing the rules that a tree calls for. What maps to
what (languages to directories, packages to directories, scanners to suffixes) are tables of the
caller's, so that a corpus of any layout can be used."""

from __future__ import annotations

import functools
import json
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import any_of
from ..lineage import cut
from . import yamltext
from .literals import LIKE, STRETCH, Ends, Rule, Tried, bits_of, end_of, literals, scanner

RULE = "path string, id string, languages array<string>, severity string, message string, pattern_regex string, regexes array<string>, not_regexes array<string>, metavariables array<struct<name string, regex string>>, includes array<string>, excludes array<string>"
RULE_COLUMNS = "path id languages severity message pattern_regex regexes not_regexes metavariables includes excludes".split()
#: Rules whose expressions go to the tasks at once, and that a worker keeps.
BLOCK = 20_000
#: Bits, as powers of two, of a filter's slice and of the largest filter (32 MB).
SLICE, FILTER = 21, 28
#: Languages of rules that read files of every language.
ANY_LANGUAGE = {"regex", "generic", "none"}


def _texts(value) -> list[str]:
    return [str(x) for x in value] if isinstance(value, list) else []


def _expressions(rule: dict) -> tuple[list[str], list[str], list[tuple[str, str]]]:
    """A rule's expressions, of which one must match, those that must not, and what its groups must match; no
    expressions where a rule needs more than expressions."""
    any_of_, not_, groups = [], [], []
    parts = rule.get("patterns")
    for part in parts if isinstance(parts, list) else [rule]:
        if not isinstance(part, dict):
            return [], [], []
        for key, value in part.items():
            if key == "pattern-regex" and isinstance(value, str) and not any_of_:
                any_of_ = [value]
            elif key == "pattern-either" and not any_of_ and isinstance(value, list) and all(isinstance(x, dict) and set(x) == {"pattern-regex"} for x in value):
                any_of_ = [str(x["pattern-regex"]) for x in value]
            elif key == "pattern-not-regex" and isinstance(value, str):
                not_.append(value)
            elif key == "metavariable-regex" and isinstance(value, dict):
                groups.append((str(value.get("metavariable") or "").lstrip("$"), str(value.get("regex") or "")))
            elif key.startswith(("pattern", "metavariable")) and key != "patterns":
                return [], [], []
    return any_of_, not_, groups


def read(files: DataFrame) -> DataFrame:
    """Rules of YAML files (path, content), one row each; files that do not parse have none."""

    def run(frames):
        import yaml

        for f in frames:
            rows = []
            for path, content in zip(f["path"], f["content"], strict=True):
                try:
                    found = (yamltext.load(content or "") or {}).get("rules") or []
                except (yaml.YAMLError, AttributeError, RecursionError):
                    found = []
                for r in found:
                    if isinstance(r, dict):
                        regex, where = r.get("pattern-regex"), r.get("paths") if isinstance(r.get("paths"), dict) else {}
                        rows.append((path, str(r.get("id") or ""), _texts(r.get("languages")), r.get("severity"), r.get("message"), regex if isinstance(regex, str) else None, *_expressions(r), _texts(where.get("include")), _texts(where.get("exclude"))))
            yield pd.DataFrame(rows, columns=RULE_COLUMNS)

    return files.where(F.col("path").rlike(r"\.ya?ml$")).select("path", "content").mapInPandas(run, RULE)


def counts(rules: DataFrame) -> DataFrame:
    return rules.groupBy("path").agg(F.count("*").alias("rules"))


def without(rules: DataFrame, bad: DataFrame) -> DataFrame:
    """Rules that are not on a list of (path, id) known to fail."""
    return rules.join(bad, ["path", "id"], "left_anti")


def accepts(language: Column, detected: list[str]) -> Column:
    """Does a language occur in a tree? JavaScript rules also serve TypeScript."""
    known = set(detected) | ({"javascript"} if "typescript" in detected else set())
    return language.isin(*known) if known else F.lit(False)


def directories(rule_dirs: DataFrame, detected: list[str], infrastructure: list[str] = (), markers: DataFrame | None = None) -> DataFrame:
    """Rule directories (path) of the detected languages, and of the infrastructure whose marker files
    the tree has; markers: (kind) found."""
    head = F.substring_index("path", "/", 1)
    chosen = rule_dirs.where(accepts(head, detected))
    if markers is not None and infrastructure:
        chosen = chosen.unionByName(rule_dirs.where(head.isin(*infrastructure)).join(markers.select(F.col("kind").alias("_k")).distinct(), head == F.col("_k"), "left_semi"))
    return chosen.distinct()


def for_signals(signal_dirs: DataFrame, signals: DataFrame, rule_dirs: DataFrame, detected: list[str]) -> DataFrame:
    """Directories that frameworks or packages call for: signal_dirs (signal, path) met by signals
    (signal), of a detected language, and there."""
    hit = signal_dirs.join(signals.select("signal").distinct(), "signal", "left_semi").select("path").distinct()
    return hit.where(accepts(F.substring_index("path", "/", 1), detected)).join(rule_dirs, "path", "left_semi")


def targeted(selected: DataFrame, baseline: DataFrame, seen: DataFrame) -> DataFrame:
    """What a targeted scan adds: neither in the baseline nor run before."""
    return selected.join(baseline, "path", "left_anti").join(seen, "path", "left_anti").distinct()


def signals(dependencies: DataFrame, manifests: DataFrame, names: list[str]) -> DataFrame:
    """Package signals: npm dependencies by name, others by a mention in a manifest's text."""
    npm = dependencies.where("ecosystem = 'npm'").select(F.lower("name").alias("signal"))
    low = F.lower("content")
    said = manifests.select(F.explode(F.array_compact(F.array(*[F.when(low.contains(n), F.lit(n)) for n in names]))).alias("signal")) if names else npm.limit(0)
    return npm.unionByName(said).distinct()


def scannable(files: DataFrame, suffixes: list[str]) -> DataFrame:
    """The files that a scanner reads, by suffix; all where it has no list."""
    return files.where(any_of([F.lower("path").endswith(s) for s in suffixes])) if suffixes else files


def planned_suites(requested: DataFrame, defaults: DataFrame, baseline: DataFrame, language: str) -> DataFrame:
    """Query suites (suite) of a targeted run: what is asked for; else the defaults that the baseline
    has not run; else the defaults. Suites belong to the language."""
    mine = lambda df: df.where(any_of([F.col("suite").startswith(f"{x}-") | F.col("suite").startswith(f"{x}/") | F.col("suite").contains(f"/{x}-") for x in {language, "javascript" if language == "typescript" else language}])).select("suite").distinct()
    asked, usual = mine(requested), mine(defaults)
    rest = usual.join(baseline.select("suite"), "suite", "left_anti")
    ranked = asked.withColumn("r", F.lit(0)).unionByName(rest.withColumn("r", F.lit(1))).unionByName(usual.withColumn("r", F.lit(2)))
    best = ranked.agg(F.min("r").alias("r"))
    return ranked.join(F.broadcast(best), "r").select("suite")


def matches(files: DataFrame, rules: DataFrame) -> DataFrame:
    """(path, line, rule_id, severity) of the lines of files (path, content, and language if rules are
    to be held against it) that rules of expressions match.

    Literals that expressions cannot do without tell which rules may match which lines: one pass over the
    files finds the lines in which ends of literals may stand, and these meet the rules by equality, so
    neither the passes nor what the driver holds grow with the rules. A filter of bounded size comes before
    the join; it only spares rows. Rules without a literal must be tried on every line; they come
    in blocks of a bounded number, each one pass over the files."""
    rows = cut(_expressions_of(rules))
    out = _by_literals(files, rows.where("literals is not null"))
    for block in _blocks(rows.where("literals is null")):
        found = _scan(files, block)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else files.select("path", F.lit(0).alias("line"), F.lit("").alias("rule_id"), F.lit("").alias("severity")).limit(0)


def _expressions_of(rules: DataFrame) -> DataFrame:
    """Rules with expressions, and the literals (with the hash of the end, how long it is and its last two
    characters) of which a match has one. Rules of one expression may come without the columns of the others."""
    has = lambda name, kind: F.col(name) if name in rules.columns else F.lit(None).cast(kind)
    one = F.when(F.col("pattern_regex").isNotNull(), F.array("pattern_regex"))
    empty_ = F.array().cast("array<string>")
    regexes = F.coalesce(F.when(F.size(has("regexes", "array<string>")) > 0, has("regexes", "array<string>")), one if "regexes" not in rules.columns else F.lit(None))
    lists = [F.coalesce(has(n, "array<string>"), empty_).alias(n) for n in ("languages", "not_regexes", "includes", "excludes")]
    groups = has("metavariables", "array<struct<name string, regex string>>").alias("metavariables")

    def needed(expressions: pd.Series) -> pd.Series:
        out = []
        for some in expressions:
            each = [literals(p) for p in some]
            out.append([(x, *end_of(x)) for x in sorted({x for found in each for x in found})] if all(each) else None)
        return pd.Series(out)

    found = F.pandas_udf(needed, "array<struct<literal:string,end:bigint,size:int,pair:int>>")
    rows = rules.select("id", "severity", regexes.alias("regexes"), *lists, groups).where("regexes is not null")
    return rows.withColumn("literals", found("regexes"))


def _blocks(rows: DataFrame):
    """Rules, so many at a time."""
    block: list[Rule] = []
    for r in rows.toLocalIterator():
        block.append(Rule(r.id, r.severity, list(r.regexes), list(r.not_regexes), [tuple(x) for x in r.metavariables or []], set(r.languages), list(r.includes), list(r.excludes)))
        if len(block) == BLOCK:
            yield block
            block = []
    if block:
        yield block


def _filter(ends: DataFrame) -> Ends | None:
    """A filter of the ends (end, size, pair), its bits set by tasks, each a slice of its own."""
    n = ends.count()
    if not n:
        return None
    size = 1 << min(max((64 * n - 1).bit_length(), SLICE), FILTER)

    def bits(frames):
        for f in frames:
            at = np.concatenate(bits_of(f["end"].to_numpy(), size)).astype("int64")
            yield pd.DataFrame({"slice": (at >> SLICE).astype("int32"), "bit": (at & ((1 << SLICE) - 1)).astype("int32")})

    def packed(frame):
        held = np.zeros(1 << SLICE, bool)
        held[frame["bit"].to_numpy()] = True
        return pd.DataFrame({"slice": frame["slice"].head(1), "bits": [np.packbits(held, bitorder="little").tobytes()]})

    out = bytearray(size // 8)
    for r in ends.select("end").mapInPandas(bits, "slice int, bit int").distinct().groupBy("slice").applyInPandas(packed, "slice int, bits binary").toLocalIterator():
        out[r.slice << (SLICE - 3) : (r.slice + 1) << (SLICE - 3)] = r.bits
    return Ends([tuple(r) for r in ends.select("size", "pair").distinct().collect()], bytes(out))


def _by_literals(files: DataFrame, rules: DataFrame) -> DataFrame | None:
    """What rules with literals match. A rule is tried on a line by the first of its literals in it."""
    ends = rules.select(F.explode("literals").alias("x")).select("x.*")
    known = _filter(ends)
    if known is None:
        return None
    sent = files.sparkSession.sparkContext.broadcast(known)
    language = F.col("language") if "language" in files.columns else F.lit(None).cast("string")

    def seen(frames):
        for f in frames:
            f = f[f["content"].astype(bool)]
            paths, texts, languages = (f[c].tolist() for c in ("path", "content", "language"))
            sizes = np.cumsum([len(x) for x in texts]) // STRETCH
            for k in np.unique(sizes):
                a, b = np.searchsorted(sizes, k), np.searchsorted(sizes, k, "right")
                rows = [(paths[a + i], languages[a + i], *rest) for i, *rest in sent.value.lines(texts[a:b])]
                yield pd.DataFrame(rows, columns=["path", "language", "line", "content", "end"])

    def held(frames):
        for f in frames:
            rows = []
            for path, lang, line, content, rule in zip(f["path"], f["language"], f["line"], f["content"], f["rule"], strict=True):
                one = _tried(rule)
                if one.reads(path, lang) and one.matches(content):
                    rows.append((path, line, one.rule.id, one.rule.severity))
            yield pd.DataFrame(rows, columns=["path", "line", "rule_id", "severity"]).astype({"line": "int32"})

    lines = files.select("path", "content", language.alias("language")).mapInPandas(seen, "path string, language string, line int, content string, end bigint")
    rule = F.to_json(F.struct("id", "severity", "regexes", "not_regexes", "metavariables", "languages", "includes", "excludes"))
    told = rules.select(rule.alias("rule"), F.col("literals.literal").alias("literals"), F.posexplode("literals").alias("place", "x")).select("rule", "literals", "place", "x.literal", "x.end")
    low = F.lower(F.translate("content", "".join(map(chr, LIKE)), "".join(LIKE.values())))
    said = lines.join(told, "end").withColumn("low", low)
    earlier = F.exists(F.slice("literals", F.lit(1), F.col("place")), lambda x: F.contains(F.col("low"), x))
    said = said.where(F.contains("low", F.col("literal")) & ~earlier).select("path", "language", "line", "content", "rule")
    # a line that many rules may match, and a rule that may match many lines, are tried all over
    return said.repartition("path", "line", "rule").mapInPandas(held, "path string, line int, rule_id string, severity string")


@functools.lru_cache(BLOCK)
def _tried(rule: str) -> Tried:
    """A rule of a line, compiled once while a worker keeps it."""
    r = json.loads(rule)
    return Tried(Rule(r["id"], r.get("severity"), r["regexes"], r["not_regexes"], [(g.get("name"), g.get("regex")) for g in r.get("metavariables") or []], set(r["languages"]), r["includes"], r["excludes"]))


def _scan(files: DataFrame, block: list[Rule]) -> DataFrame:
    sent, key = files.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex
    language = F.col("language") if "language" in files.columns else F.lit(None).cast("string")

    def run(frames):
        held = scanner(key, lambda: sent.value)
        for f in frames:
            rows = [(p, *hit) for p, c, lang in zip(f["path"], f["content"], f["language"], strict=True) if c for hit in held.hits(p, c, lang)]
            yield pd.DataFrame(rows, columns=["path", "line", "rule_id", "severity"]).astype({"line": "int32"})

    return files.select("path", "content", language.alias("language")).mapInPandas(run, "path string, line int, rule_id string, severity string")


def expanded(selected: DataFrame, rule_dirs: DataFrame) -> DataFrame:
    """Selected directories (path), those at the root replaced by the directories in them, if any."""
    children = rule_dirs.select(F.regexp_extract("path", "^([^/]+)/[^/]+$", 1).alias("_root"), "path").where("_root <> ''").distinct()
    roots = selected.where(~F.col("path").contains("/")).select(F.col("path").alias("_root")).distinct().join(children, "_root", "left")
    return selected.where(F.col("path").contains("/")).select("path").unionByName(roots.select(F.coalesce("path", "_root").alias("path"))).distinct()


def suite_matches(language: Column, suite: Column) -> Column:
    """Is a query suite one of a language's? JavaScript takes TypeScript's, too."""
    low = F.lower(suite)
    of = lambda prefix: low.startswith(F.concat(prefix, F.lit("-"))) | low.contains(F.concat(F.lit("/"), prefix, F.lit("-"))) | low.contains(F.concat(F.lit("\\"), prefix, F.lit("-")))
    return of(language) | ((language == "javascript") & of(F.lit("typescript")))


def heuristic(languages: DataFrame, frameworks: DataFrame, choices: DataFrame) -> DataFrame:
    """(tree_id, kind, value, place): what a tree's languages and frameworks call for, each value once, in
    the order of the choices (ordinal, language, framework, kind, value); a choice without a framework
    needs the language only."""
    by_language = languages.select("tree_id", F.lower("language").alias("language")).distinct().join(choices, "language")
    there = frameworks.select("tree_id", F.lower("framework").alias("framework")).distinct()
    plain = by_language.where("framework is null").drop("framework")
    called = by_language.where("framework is not null").join(there, ["tree_id", "framework"], "left_semi").drop("framework")
    first = plain.unionByName(called).groupBy("tree_id", "kind", "value").agg(F.min("ordinal").alias("ordinal"))
    place = F.row_number().over(Window.partitionBy("tree_id", "kind").orderBy("ordinal", "value"))
    return first.select("tree_id", "kind", "value", place.alias("place"))
