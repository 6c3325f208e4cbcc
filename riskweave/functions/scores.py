"""Scores, grades and ladders as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed, paths
from .columns import any_of, let, lookup, sum_of


def severity_rank(severity: Column) -> Column:
    return lookup(F.lower(severity), fixed.SEVERITY_RANK, 0)


def severity_of_score(score: Column, unknown: Column | str = "medium") -> Column:
    """critical from 9, high from 7, medium from 4, else low."""
    other = F.lit(unknown) if isinstance(unknown, str) else unknown
    return F.when(score.isNull(), other).when(score >= 9, "critical").when(score >= 7, "high").when(score >= 4, "medium").otherwise("low")


def ladder(value: Column, steps: list[tuple[float, str]], last: str, upward: bool = True) -> Column:
    """The first step that a value is within: at most it (upward), or at least it."""
    out = None
    for limit, label in steps:
        fits = value <= limit if upward else value >= limit
        out = F.when(fits, label) if out is None else out.when(fits, label)
    return out.otherwise(last)


def risk_grade(score: Column) -> Column:
    return ladder(score, [(5, "A"), (15, "B"), (35, "C"), (60, "D")], "F")


def component_grade(score: Column) -> Column:
    return ladder(score, [(90, "A"), (75, "B"), (55, "C"), (35, "D")], "F", upward=False)


def risk_points(severity: Column, confidence: Column, difficulty: Column) -> Column:
    """What one finding adds to the risk score."""
    return lookup(severity, fixed.RISK_WEIGHT, 3) * confidence + lookup(difficulty, fixed.EXPLOIT_BONUS, 0) * confidence


def file_score(path: Column, lines: Column, hits: Column, dependency_risk: Column | None = None, secret: Column | None = None) -> Column:
    """(score, reasons): priority of a file for inspection."""
    low = F.lower(path)
    match = lambda sign: [F.when(low.rlike(p), float(s)) for p, s in fixed.PATH_SCORES if s * sign > 0]
    place = F.coalesce(F.greatest(*match(1)), F.lit(0.0)) + F.coalesce(F.least(*match(-1)), F.lit(0.0))
    size = F.when((lines > 10) & (lines < 500), 5.0).when((lines >= 500) & (lines < 2000), 3.0).when(lines >= 2000, 1.0).otherwise(0.0)
    scanner = F.least(hits * 5.0, F.lit(30.0))
    weight = lookup(paths.extension(path), fixed.EXTENSION_WEIGHT, fixed.OTHER_EXTENSION_WEIGHT)
    risk = F.when(F.coalesce(dependency_risk, F.lit(False)), 10.0).otherwise(0.0) if dependency_risk is not None else F.lit(0.0)
    hidden = F.when(F.coalesce(secret, F.lit(False)), 15.0).otherwise(0.0) if secret is not None else F.lit(0.0)
    reasons = F.map_filter(F.create_map(*[x for k, v in (("path_match", place), ("scanner_hits", scanner), ("dep_risk", risk), ("secret_candidate", hidden)) for x in (F.lit(k), v)]), lambda k, v: v != 0)
    reasons = F.map_concat(F.create_map(F.lit("extension"), weight, F.lit("size"), size), reasons)
    return F.struct(((place + size + scanner + risk + hidden) * weight).alias("score"), reasons.alias("reasons"))


def obfuscation(content: Column, path: Column, language: Column) -> Column:
    """(score, label, analysable, avg_line, max_line) of a source text; lines end at ``\\n``. Each
    pattern runs once over the text, then the score is built from the counts."""
    text, low = F.coalesce(content, F.lit("")), F.lower(path)
    lines = F.transform(F.split(F.regexp_replace(text, "\n$", ""), "\n", -1), lambda x: F.length(x))
    times = lambda p: F.regexp_count(text, F.lit(p))
    java = language.isin("java", "kotlin")
    only_java = lambda c: F.when(java, c).otherwise(0)
    facts = F.struct(
        lines.alias("lines"), (F.length(text) - F.length(F.translate(text, " \t\n", ""))).alias("blank"), any_of([text.rlike(p) for p in fixed.PACKERS]).alias("packed"),
        times(fixed.HEX_ESCAPE).alias("hexes"), times(fixed.UNICODE_ESCAPE).alias("unicodes"), times(fixed.HEX_NAME).alias("names"), times(fixed.DENSE).alias("dense"),
        F.transform(F.regexp_extract_all(text, F.lit(fixed.IDENTIFIER), F.lit(0)), lambda w: F.length(w)).alias("words"),
        F.array_max(F.transform(F.regexp_extract_all(text, F.lit(fixed.BASE64_RUN), F.lit(0)), lambda x: F.length(x))).alias("base64"),
        only_java(times(r"\bgoto\b")).alias("jumps"), only_java(F.when(text.rlike("/\\* JADX|// JADX"), times("JADX")).otherwise(0)).alias("marks"),
        only_java(times(r"import\s+[a-z](\.[a-z]){2,};")).alias("short_imports"), (java & text.rlike(r"\bclass\s+[a-z]\b")).alias("short_class"),
        text.rlike(fixed.SOURCE_MAP).alias("mapped"), (~text.rlike(r"\S")).alias("void"),
    )
    more = lambda f: F.struct(
        F.size(f["lines"]).alias("count"), F.aggregate(f["lines"], F.lit(0), lambda a, b: a + b).alias("total"), F.array_max(f["lines"]).alias("longest"),
        F.size(f["words"]).alias("words"), F.size(F.filter(f["words"], lambda n: n == 1)).alias("single"), f.alias("f"),
    )
    bundle, vendor = low.rlike(r"\.bundled?\."), low.rlike("vendor/|third_party/|third-party/")
    coded = language.isin("javascript", "typescript", "java", "kotlin")
    when = lambda *steps: F.coalesce(*[F.when(c, F.lit(v)) for c, v in steps], F.lit(0.0))

    def total_score(m: Column) -> Column:
        f, total, words = m["f"], m["total"], m["words"]
        average, share, single = F.try_divide(total, m["count"]), F.try_divide(f["blank"], total), F.try_divide(m["single"], words)
        marks = f["marks"] + F.when(f["jumps"] > 3, f["jumps"]).otherwise(0)
        score = sum_of([
            when((low.contains(".min."), 0.6)),
            when((bundle, 0.3)),
            when((vendor, 0.2)),
            when((low.rlike("/dist/|/build/"), 0.15)),
            when((m["longest"] > 5000, 0.5), ((m["longest"] > 1000) & (m["count"] < 20), 0.4), (average > 200, 0.3)),
            when(((share < 0.05) & (total > 500), 0.4), ((share < 0.10) & (total > 1000), 0.2)),
            when((f["packed"], 0.5)),
            when((f["hexes"] > 20, 0.3), (f["hexes"] > 5, 0.1)),
            when((f["unicodes"] > 50, 0.2)),
            when((f["names"] > 5, 0.5), (f["names"] > 0, 0.2)),
            when((coded & (total > 500) & (single > 0.3) & (words > 50), 0.3), (coded & (total > 500) & (single > 0.2) & (words > 100), 0.15)),
            when((f["short_imports"] > 3, 0.3)),
            when((f["short_class"], 0.2)),
            when((marks > 5, 0.15)),
            when((f["base64"] > 500, 0.3), (f["base64"] > 100, 0.1)),
            when((f["mapped"], 0.1)),
            when(((f["dense"] > 20) & (average > 100), 0.15)),
        ])
        return F.struct(F.least(F.lit(1.0), score).alias("score"), average.alias("average"), m["longest"].alias("longest"), (f["packed"] | (f["names"] > 0)).alias("coded"), f["void"].alias("void"))

    def verdict(x: Column) -> Column:
        score, void, source_map = x["score"], x["void"], path.endswith(".map")
        label = F.when((score >= 0.7) & x["coded"], "obfuscated").when((score >= 0.5) & (bundle | vendor), "vendor_bundle").when(score >= 0.4, "minified").when(score >= 0.15, "possibly_minified").otherwise("clean")
        return F.struct(
            F.when(void, 0.0).when(source_map, 1.0).otherwise(score).alias("score"), F.when(void, "empty").when(source_map, "source_map").otherwise(label).alias("label"), (~void & ~source_map & (score < 0.7)).alias("analysable"),
            F.when(void | source_map, 0.0).otherwise(x["average"]).alias("avg_line"), F.when(void | source_map, 0).otherwise(x["longest"]).alias("max_line"),
        )

    return let(let(let(facts, more), total_score), verdict)


def obfuscation_severity(score: Column) -> Column:
    return ladder(score, [(0.8, "heavy"), (0.5, "moderate"), (0.2, "light")], "none", upward=False)


def cvss3(vector: Column) -> Column:
    """Base score of a CVSS v3 vector; null if a metric is missing or unknown."""
    m = F.str_to_map(F.coalesce(vector, F.lit("")), F.lit("/"), F.lit(":"))
    metric = lambda k: F.try_element_at(m, F.lit(k))
    weight = lambda k, t: lookup(metric(k), fixed.CVSS[t])
    same = metric("S") == "U"
    iss = 1 - (1 - weight("C", "CIA")) * (1 - weight("I", "CIA")) * (1 - weight("A", "CIA"))
    impact = F.when(same, 6.42 * iss).otherwise(7.52 * (iss - 0.029) - 3.25 * F.pow(iss - 0.02, 15))
    easy = 8.22 * weight("AV", "AV") * weight("AC", "AC") * F.when(same, weight("PR", "PR_U")).otherwise(weight("PR", "PR_C")) * weight("UI", "UI")
    up = lambda x: F.least(F.ceil(x * 10) / 10.0, F.lit(10.0))
    known = iss.isNotNull() & easy.isNotNull() & metric("S").isNotNull()
    return F.when(known, F.when(impact <= 0, 0.0).when(same, up(impact + easy)).otherwise(up(1.08 * (impact + easy))))


def reachability(is_dev: Column, relevance: Column, function_hit: Column, imported: Column) -> Column:
    """(status, confidence) of a vulnerable dependency."""
    pair = lambda s, c: F.struct(F.lit(s).alias("status"), F.lit(c).alias("confidence"))
    out = F.when(is_dev | (relevance == "test_only"), pair("not_applicable", 0.95)).when(function_hit & imported, pair("reachable", 0.9)).when(function_hit, pair("reachable", 0.8))
    out = out.when(relevance == "used", pair("potentially_reachable", 0.7)).when(relevance == "likely_used", pair("potentially_reachable", 0.55))
    return out.when(relevance == "transitive_only", pair("no_path_found", 0.8)).otherwise(pair("no_path_found", 0.45))


def relevance(direct: Column, referenced: Column, tested: Column, is_dev: Column, transitive: Column) -> Column:
    """How a dependency is used, from what hits there are: imports and references outside tests,
    hits in tests; a lockfile entry that no manifest declares is transitive."""
    return F.when(direct, "used").when(referenced, "likely_used").when(is_dev | tested, "test_only").when(transitive, "transitive_only").otherwise("unknown")


def normal_relevance(value: Column) -> Column:
    return lookup(F.lower(F.trim(value)), fixed.RELEVANCE_NAMES, "unknown")


def normal_reachability(value: Column) -> Column:
    return lookup(F.lower(F.trim(value)), fixed.REACHABILITY_NAMES, "unknown")


def dependency_risk(severity: Column, cvss: Column, reach: Column, rel: Column, function_hit: Column, is_dev: Column, fixed_version: Column, hot: Column) -> Column:
    """(score, factors) of a vulnerable dependency, 0 to 1000."""
    base = lookup(F.lower(F.coalesce(severity, F.lit("medium"))), fixed.DEPENDENCY_BASE, 300.0)
    # greatest and least pass over nulls, so an unknown score must not become the cap
    base = F.greatest(base, F.when(cvss.isNotNull(), F.least(F.lit(900.0), cvss * 100.0)))
    bonus = lambda c, v: F.when(F.coalesce(c, F.lit(False)), v).otherwise(0.0)
    always = {"base": base, "reachability": lookup(reach, fixed.REACHABILITY_BONUS, 0.0), "relevance": lookup(rel, fixed.RELEVANCE_BONUS, 0.0)}
    maybe = {"vulnerable_function_match": bonus(function_hit, 120.0), "dev_dependency": bonus(is_dev, -120.0), "fix_available": bonus(F.coalesce(fixed_version, F.lit("")) != "", 25.0), "hot_file_usage": bonus(hot, 40.0)}
    score = F.greatest(F.lit(0.0), F.least(F.lit(1000.0), sum_of([*always.values(), *maybe.values()])))
    pairs = lambda d: F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.round(v, 1))])
    factors = F.map_concat(pairs(always), F.map_filter(pairs(maybe), lambda k, v: v != 0), F.create_map(F.lit("final"), F.round(score, 1)))
    return F.struct(F.round(score, 1).alias("score"), factors.alias("factors"))


def top_factors(factors: Column, limit: int = 3) -> Column:
    """The strongest factors of a risk score, as name and value."""
    entries = F.filter(F.map_entries(factors), lambda e: ~e["key"].isin("base", "final") & (e["value"] != 0))
    ordered = F.array_sort(F.transform(entries, lambda e: F.struct((-F.abs(e["value"])).alias("o"), e["key"].alias("k"), e["value"].alias("v"))))
    return F.array_join(F.transform(F.slice(ordered, 1, limit), lambda e: F.concat_ws("=", e["k"], e["v"].cast("string"))), ", ")


def candidate_confidence(value: Column) -> Column:
    """A confidence written as text: a half where it is no number, none where it is missing."""
    return F.when(value.isNull(), 0.0).otherwise(F.coalesce(value.try_cast("double"), F.lit(0.5)))
