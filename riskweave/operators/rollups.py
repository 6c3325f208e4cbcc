"""Report roll-ups over findings, dependencies and files. Findings have severity, confidence,
status, category, title and so on; dismissed ones never count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, scores
from ..functions.columns import lookup


def live(findings: DataFrame) -> DataFrame:
    return findings.where(F.coalesce(F.col("status"), F.lit("")) != "dismissed")


def max_severity(severity: Column) -> Column:
    return F.max_by(severity, scores.severity_rank(severity))


def severity_counts(findings: DataFrame, *keys: str) -> DataFrame:
    """Counts of the five severities; severities without a row have none."""
    return findings.where(F.col("severity").isin(*fixed.SEVERITY_RANK)).groupBy(*keys, "severity").agg(F.count("*").alias("n"))


def risk_scores(findings: DataFrame, *keys: str) -> DataFrame:
    """Risk score (0 to 100) and grade of each scan; a scan with nothing but dismissed findings
    scores 0."""
    rows = findings.withColumn("_points", F.when(F.coalesce(F.col("status"), F.lit("")) != "dismissed", scores.risk_points(F.col("severity"), F.col("confidence"), F.col("exploit_difficulty"))).otherwise(0.0))
    raw = F.least(F.lit(100.0), F.round(F.sum("_points"), 6))
    return rows.groupBy(*keys).agg(raw.alias("raw")).select(*keys, F.round("raw", 1).alias("risk_score"), scores.risk_grade(F.col("raw")).alias("grade"))


def owasp_code(cwes: Column, category: Column) -> Column:
    """The OWASP code of a finding: of its first known weakness, else of its category, else A04."""
    known = F.filter(F.transform(F.coalesce(cwes, F.array().cast("array<string>")), lambda c: lookup(c, fixed.OWASP_OF_CWE)), lambda c: c.isNotNull())
    return F.coalesce(F.try_element_at(known, F.lit(1)), lookup(category, fixed.OWASP_OF_CATEGORY), F.lit("A04"))


def owasp(findings: DataFrame, *keys: str) -> DataFrame:
    """Findings by OWASP code: count, sorted titles, highest severity."""
    rows = live(findings).withColumn("code", owasp_code(F.col("cwe_ids"), F.col("category")))
    out = rows.groupBy(*keys, "code").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("title")).alias("titles"), max_severity(F.col("severity")).alias("max_severity"))
    return out.withColumn("name", lookup(F.col("code"), fixed.OWASP_NAMES))


def attack_surface(findings: DataFrame, hit_counts: DataFrame | None = None) -> DataFrame:
    """Findings by display category; hits of the secrets and dependency scanners stand in where
    their category has no finding. hit_counts: (scanner, n)."""
    category = F.coalesce(F.nullif(F.col("category"), F.lit("")), F.lit("other"))
    shown = F.coalesce(lookup(category, fixed.SURFACE_NAMES), F.initcap(F.replace(category, F.lit("_"), F.lit(" "))))
    out = live(findings).groupBy(shown.alias("surface")).agg(F.count("*").alias("n"))
    if hit_counts is None:
        return out
    names = {"secrets": "Secrets Exposure", "dep_audit": "Dependencies"}
    extra = hit_counts.where(F.col("scanner").isin(*names) & (F.col("n") > 0)).select(lookup(F.col("scanner"), names).alias("surface"), F.col("n").cast("bigint").alias("n"))
    return out.unionByName(extra.join(out, "surface", "left_anti"))


def in_component(findings: DataFrame, components: DataFrame, separator: bool) -> DataFrame:
    """Findings with the components whose path begins theirs, each component once. The distinct paths
    are exploded into their prefixes, so the prefix test is an equi-join: at a separator, or at any
    character that a component's path ends at."""
    files = findings.select("file_path").distinct()
    parted = components.select("component", F.explode("files").alias("_prefix"))
    path = F.col("file_path")
    if separator:
        parts = F.split(path, "/")
        cuts = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    else:
        lengths = parted.agg(F.sort_array(F.collect_set(F.length("_prefix"))).alias("ns")).first().ns
        cuts = F.array_compact(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths])) if lengths else F.array().cast("array<string>")
    owners = files.withColumn("_prefix", F.explode(cuts)).join(parted, "_prefix").select("file_path", "component").distinct()
    # a component's own columns are added to its paths, as a join of findings by component would gather each in a task
    return findings.join(owners.join(components.drop("files"), "component"), "file_path")


def component_scores(findings: DataFrame, components: DataFrame) -> DataFrame:
    """100 less the penalties of a component's findings, its grade and its severities. The path test
    takes no separator."""
    found = in_component(live(findings), components, separator=False)
    penalty = lookup(F.col("severity"), fixed.COMPONENT_PENALTY, 3) * F.col("confidence")
    each = found.groupBy("component", "severity").agg(F.sum(penalty).alias("p"), F.count("*").alias("n"))
    counted = each.groupBy("component").agg(F.sum("p").alias("p"), F.sum("n").alias("n"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("severity", "n")))).alias("severities"))
    raw = F.greatest(F.lit(0.0), 100 - F.round(F.coalesce("p", F.lit(0.0)), 6))
    return components.drop("files").join(counted, "component", "left").select("component", F.round(raw, 1).alias("score"), scores.component_grade(raw).alias("grade"), F.coalesce("n", F.lit(0)).alias("n"), "severities")


def component_hotspots(findings: DataFrame, components: DataFrame, limit: int = 8) -> DataFrame:
    """The components with most critical, then most high, then most findings; paths part at ``/``."""
    found = in_component(live(findings), components, separator=True)
    out = found.groupBy("component").agg(F.count_if(F.col("severity") == "critical").alias("critical"), F.count_if(F.col("severity") == "high").alias("high"), F.count("*").alias("n"), max_severity(F.col("severity")).alias("max_severity"))
    return out.orderBy(F.desc("critical"), F.desc("high"), F.desc("n"), "component").limit(limit)


def category_distribution(findings: DataFrame, limit: int = 10) -> DataFrame:
    name = F.coalesce(F.nullif(F.lower(F.trim("category")), F.lit("")), F.lit("uncategorized"))
    return findings.groupBy(name.alias("category")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category").limit(limit)


def confidence_histogram(findings: DataFrame) -> DataFrame:
    """Findings by confidence: 90 % and more, 70, 50, less; empty bands have no row."""
    return findings.groupBy(scores.ladder(F.col("confidence"), [(0.9, ">=90"), (0.7, "70-89"), (0.5, "50-69")], "<50", upward=False).alias("band")).agg(F.count("*").alias("n"))


def report_counters(findings: DataFrame, *keys: str) -> DataFrame:
    """Counters of live findings: how many, of which origin, merged duplicates."""
    return live(findings).groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.count_if(F.col("provenance") == "llm").alias("from_llm"),
        F.count_if(F.col("provenance") == "scanner").alias("from_scanner"),
        F.sum(F.greatest(F.col("merged_count") - 1, F.lit(0))).cast("bigint").alias("merged_away"),
    )


def sbom(dependencies: DataFrame, vulnerabilities: DataFrame) -> DataFrame:
    """Components of the bill of materials: dependencies of one identity are one, with their
    distinct vulnerabilities counted and the first three named."""
    identity = ["ecosystem", "name", "version", "source_file", "is_dev"]
    hits = vulnerabilities.select("dependency_id", F.coalesce("advisory_id", "cve_id").alias("v")).where("v is not null").distinct()
    rows = dependencies.join(hits, dependencies.id == hits.dependency_id, "left")
    out = rows.groupBy(*identity).agg(F.sort_array(F.collect_set("v")).alias("all"))
    return out.select(*identity, F.size("all").alias("vulnerability_count"), F.slice("all", 1, 3).alias("vulnerabilities"))


def sbom_totals(components: DataFrame) -> DataFrame:
    return components.groupBy("ecosystem").agg(F.count("*").alias("components"), F.count_if(F.col("vulnerability_count") > 0).alias("vulnerable"))


def dependency_summary(findings: DataFrame) -> DataFrame:
    """One row of counters over dependency findings."""
    return findings.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("reachability_status") == "reachable").alias("reachable"),
        F.count_if(F.col("relevance").isin("used", "likely_used")).alias("active"),
        F.count_if(F.col("risk_score") >= 700).alias("high_risk"),
    )


def obfuscation_summary(files: DataFrame) -> DataFrame:
    """Counts over files with a score, a label and analysable; the share has one decimal."""
    heavy, some = F.col("score") >= 0.7, (F.col("score") >= 0.4) & (F.col("score") < 0.7)
    out = files.agg(F.count("*").alias("total_files"), F.count_if(heavy | some).alias("obfuscated"), F.count_if(heavy).alias("heavy"), F.count_if(some).alias("moderate"), F.count_if(~F.col("analysable")).alias("not_analysable"))
    return out.withColumn("percentage", F.when(F.col("total_files") > 0, F.round(F.col("obfuscated") / F.col("total_files") * 100, 1)))


def touchpoints(imports: DataFrame) -> DataFrame:
    """External modules by the number of files that import them, with the first three files."""
    top = F.regexp_extract("import_module", "^@?[^./]+", 0)
    out = imports.where("is_external").groupBy(top.alias("module")).agg(F.count_distinct("source_file").alias("files"), F.slice(F.sort_array(F.collect_set("source_file")), 1, 3).alias("first"))
    return out.where("module <> ''")


# Words of paths and imports, and what they have to do with.
TOUCHPOINTS = {"auth": "auth", "login": "auth", "oauth": "auth", "jwt": "auth", "session": "auth", "permission": "authorization", "role": "authorization", "middleware": "middleware", "guard": "middleware", "config": "config", "settings": "config", "env": "config", "secret": "secrets", "credential": "secrets"}


def security_touchpoints(facts: DataFrame) -> DataFrame:
    """(path, labels) of files whose path or imported modules hold one of the words, labels in order."""
    said = F.lower(F.concat_ws("\n", "path", F.when(F.col("kind") == "import", F.col("name"))))
    labels = F.array_compact(F.array(*[F.when(said.contains(w), F.lit(label)) for w, label in TOUCHPOINTS.items()]))
    return facts.select("path", F.explode(labels).alias("label")).groupBy("path").agg(F.sort_array(F.collect_set("label")).alias("labels"))


def coverage_status(runs: DataFrame) -> DataFrame:
    """Scanner runs with their status: failed, degraded where there were errors, else completed."""
    return runs.withColumn("status", F.when(~F.col("success"), "failed").when(F.size("errors") > 0, "degraded").otherwise("completed"))
