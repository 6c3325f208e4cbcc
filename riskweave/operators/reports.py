"""Rows of reports and exports, the state of scans, and what a scan says about itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, text
from ..functions.columns import empty, lookup

# Order of scanner states, of diagrams, fields of versions.
RUN_ORDER = {"failed": 0, "degraded": 1, "completed": 2, "skipped": 3}
DIAGRAM_ORDER = {"overview": 0, "security": 1, "data_flow": 2, "attack_surface": 3}
VERSION_FIELDS = {"semgrep": "semgrep_version", "bandit": "bandit_version", "eslint": "eslint_version", "codeql": "codeql_version", "secrets": "secrets_version", "dep_audit": "advisory_db_ver"}


def truncated_code(snippet: Column, lines: int = 4) -> Column:
    """The first lines of a snippet, and how many more there were."""
    clean = F.btrim(F.coalesce(snippet, F.lit("")), F.lit(" \t\r\n"))
    parts = F.split(clean, "\r\n|\n|\r", -1)
    more = F.concat(F.array_join(F.slice(parts, 1, lines), "\n"), F.format_string("\n... (%d more lines)", F.size(parts) - lines))
    return F.when(F.size(parts) <= lines, clean).otherwise(more)


def truncated_text(value: Column, most: int) -> Column:
    """A text of at most so many characters; a cut one ends in three dots."""
    clean = F.btrim(F.coalesce(value, F.lit("")), F.lit(" \t\r\n"))
    return F.when(F.length(clean) <= most, clean).otherwise(F.concat(F.rtrim(F.substring(clean, 1, most - 3)), F.lit("...")))


def export_order() -> list[Column]:
    """Order of exported findings: severity (unknown ones last), then confidence."""
    rank = lookup(F.col("severity"), {k: 5 - v for k, v in fixed.SEVERITY_RANK.items()}, 9)
    return [rank, F.desc(F.coalesce("confidence", F.lit(0.0)))]


def export_rows(findings: DataFrame) -> DataFrame:
    """Live findings with their place in their scan's export."""
    order = Window.partitionBy("scan_id").orderBy(*export_order(), "finding_id")
    return findings.where(F.coalesce("status", F.lit("")) != "dismissed").withColumn("place", F.row_number().over(order))


def run_rows(runs: DataFrame) -> DataFrame:
    """The runs of each scan with their place in an export: failed, degraded, completed, skipped, others."""
    order = Window.partitionBy("scan_id").orderBy(lookup(F.col("status"), RUN_ORDER, 9), F.lower(F.coalesce("scanner", F.lit(""))), "scanner")
    return runs.withColumn("place", F.row_number().over(order))


def surface_points(attack_surface: Column, entry_points: Column) -> Column:
    """The points of an attack surface, those of the architecture before its entry points, each once."""
    clean = lambda a: F.filter(F.transform(F.coalesce(a, empty()), lambda p: F.trim(p)), lambda p: p != "")
    return F.array_distinct(F.concat(clean(attack_surface), clean(entry_points)))


def chain_steps(supporting: Column, scenario: Column) -> Column:
    """The steps of an exploit: its supporting evidence, else the lines of its scenario."""
    clean = lambda a: F.filter(a, lambda s: s != "")
    told = clean(F.transform(F.coalesce(supporting, empty()), lambda s: F.trim(s)))
    lines = clean(F.transform(F.split(F.coalesce(scenario, F.lit("")), "\r\n|\n|\r", -1), lambda s: F.trim(F.regexp_replace(F.trim(s), "^-+", ""))))
    return F.when(F.size(told) > 0, told).otherwise(lines)


def coverage_flags(coverage: Column) -> Column:
    """What an export says about a scan's coverage, in order."""
    flag = lambda c, label: F.when(F.coalesce(c, F.lit(False)), F.lit(label))
    some = lambda c, label: F.when(F.coalesce(c, F.lit(0)) > 0, F.concat(c.cast("string"), F.lit(label)))
    return F.array_compact(F.array(
        flag(coverage["degraded_coverage"], "Scanner coverage degraded"),
        flag(coverage["is_apk"], "APK decompilation"),
        flag(coverage["is_monorepo"], "Monorepo"),
        some(coverage["obfuscated_files"], " obfuscated files"),
        some(coverage["files_skipped_size"], " skipped due to size limit"),
        some(coverage["files_skipped_cap"], " skipped by scan cap"),
        some(coverage["ignored_file_count"], " ignored by scope policy"),
        F.when(F.coalesce(coverage["has_doc_intelligence"], F.lit(False)), F.concat(F.coalesce(coverage["doc_files_read"], F.lit(0)).cast("string"), F.lit(" docs analysed"))),
    ))


def merged_diagrams(canonical: DataFrame, supplemental: DataFrame) -> DataFrame:
    """Diagrams (report_id, position, kind, title, source) of two lists: of a kind (or of a title, where
    there is none) the first, the known kinds in their order. Those without a source are left out."""
    rows = canonical.withColumn("_from", F.lit(0)).unionByName(supplemental.withColumn("_from", F.lit(1)))
    rows = rows.where(F.trim(F.coalesce("source", F.lit(""))) != "")
    kind = F.nullif(F.coalesce("kind", F.lit("")), F.lit(""))
    key = F.coalesce(F.concat(F.lit("kind:"), kind), F.concat(F.lit("title:"), F.lower(F.coalesce("title", F.lit("")))))
    first = Window.partitionBy("report_id", "_key").orderBy("_from", "position")
    rows = rows.withColumn("_key", key).withColumn("_n", F.row_number().over(first)).where("_n = 1")
    order = Window.partitionBy("report_id").orderBy(lookup(kind, DIAGRAM_ORDER, 100), "_from", "position")
    return rows.withColumn("place", F.row_number().over(order)).drop("_key", "_n", "_from")


def met_again(title: Column, severity: Column, path: Column) -> Column:
    """What makes a finding the same when it is met again; category and description need not be."""
    plain = lambda c: text.normal(c, 10**6)
    where = F.regexp_replace(F.lower(F.trim(F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/")))), "^[./]+", "")
    return F.struct(plain(title).alias("title"), plain(severity).alias("severity"), where.alias("path"))


def reattached(candidates: DataFrame, persisted: DataFrame) -> DataFrame:
    """(candidate_id, finding_id): live candidates meet the rows that were persisted, each row once. Of
    the candidates (in order of place) and rows (in order of ordinal) that are the same, the n-th
    candidate gets the n-th row."""

    def numbered(df, keep, by):
        rows = df.select(keep, met_again(F.col("title"), F.col("severity"), F.col("file_path")).alias("key"), by)
        return rows.select(keep, "key", F.row_number().over(Window.partitionBy("key").orderBy(by, keep)).alias("n"))

    left = numbered(candidates.where(F.coalesce("status", F.lit("")) != "dismissed"), "candidate_id", "place")
    right = numbered(persisted.where(F.coalesce(F.col("finding_id").cast("string"), F.lit("")) != ""), "finding_id", "ordinal")
    return left.join(right, ["key", "n"]).select("candidate_id", "finding_id")


def finished(scans: DataFrame, ends: DataFrame) -> DataFrame:
    """Scans (scan_id, status, phase, error, completed_at) after their ends (scan_id, end_status,
    end_error, ended_at). A cancelled scan stays cancelled and only takes an error that it has not."""
    rows = scans.join(ends, "scan_id", "left")
    kept = (F.col("status") == "cancelled") & (F.col("end_status") != "cancelled")
    done = F.col("end_status").isNotNull() & ~kept
    say = F.nullif(F.coalesce("end_error", F.lit("")), F.lit(""))
    return rows.select(
        "scan_id",
        F.when(done, F.col("end_status")).otherwise(F.col("status")).alias("status"),
        F.when(done, F.when(F.col("end_status") == "completed", "done").otherwise(F.col("end_status"))).otherwise(F.col("phase")).alias("phase"),
        F.when(done, F.coalesce(say, "error")).when(F.col("end_status").isNotNull(), F.coalesce(F.nullif("error", F.lit("")), say)).otherwise(F.col("error")).alias("error"),
        F.when(done, F.col("ended_at")).otherwise(F.col("completed_at")).alias("completed_at"),
    )


def snapshot(events: DataFrame) -> DataFrame:
    """The newest progress of each scan (scan_id, event_id, phase, task, done, total) with its share."""
    last = events.groupBy("scan_id").agg(F.max_by(F.struct("phase", "task", "done", "total"), "event_id").alias("p"))
    return last.select("scan_id", "p.*", F.round(F.try_divide(F.col("p.done"), F.col("p.total")), 4).alias("share"))


def audit_log(decisions: DataFrame, existing: DataFrame) -> DataFrame:
    """A scan's log with new decisions (scan_id, agent, action, decided_at) behind the old ones, numbered on;
    a decision that is there already is not added again."""
    keys = ["scan_id", "agent", "action", "decided_at"]
    last = existing.groupBy("scan_id").agg(F.max("ordinal").alias("_last"))
    new = decisions.select(*keys).distinct().join(existing.select(*keys), keys, "left_anti").join(last, "scan_id", "left")
    n = F.row_number().over(Window.partitionBy("scan_id").orderBy("decided_at", "agent", "action"))
    return existing.select(*keys, "ordinal").unionByName(new.select(*keys, (F.coalesce("_last", F.lit(0)) + n).cast("bigint").alias("ordinal")))


def minimal_report(scans: DataFrame, runs: DataFrame) -> DataFrame:
    """Reports of scans without a model (scan_id, files_total, files_skipped_cap): coverage and scanners
    only, and a note where one fell short. runs: (scan_id, scanner, status)."""
    each = runs.groupBy("scan_id").agg(F.sort_array(F.collect_set("scanner")).alias("scanners_used"), F.bool_or(F.col("status").isin("failed", "degraded")).alias("degraded"))
    rows = scans.join(each, "scan_id", "left")
    return rows.select(
        "scan_id",
        F.col("files_total").alias("total_files"),
        (F.col("files_total") - F.coalesce("files_skipped_cap", F.lit(0))).alias("files_indexed"),
        F.coalesce("scanners_used", empty()).alias("scanners_used"),
        F.coalesce("degraded", F.lit(False)).alias("degraded_coverage"),
    )


def version_snapshot(config: DataFrame, versions: DataFrame) -> DataFrame:
    """(scan_id, field, version): versions of the scanners that a scan's settings (scan_id, scanner,
    enabled) switch on; null for the others, and where a version is unknown."""
    field = lookup(F.col("scanner"), VERSION_FIELDS)
    rows = config.where(field.isNotNull()).join(versions, "scanner", "left")
    return rows.select("scan_id", field.alias("field"), F.when(F.col("enabled"), F.col("version")).alias("version"))


def entry_signals(facts: DataFrame, limit: int = 12) -> DataFrame:
    """The first signals (signal) of where a program starts, by path: main functions, then routes."""
    main = facts.where((F.col("kind") == "function") & (F.col("name") == "main")).select("path", F.lit(0).alias("o"), F.concat(F.lit("Main entrypoint in "), "path").alias("signal")).distinct()
    routes = facts.where("kind = 'route'").groupBy("path").agg(F.count("*").alias("n")).select("path", F.lit(1).alias("o"), F.format_string("Route hub in %s (%d routes)", "path", "n").alias("signal"))
    return main.unionByName(routes).orderBy("path", "o").limit(limit).select("signal")


def planner_state(findings: DataFrame, flows: DataFrame) -> DataFrame:
    """Counters that a planner reads (name, n): findings by status, flows that are not sanitised, and
    those of them that a call chain verifies."""
    by_status = findings.groupBy(F.concat(F.lit("finding:"), "status").alias("name")).agg(F.count("*").alias("n"))
    of = flows.agg(F.count_if(~F.col("sanitised")).alias("open"), F.count_if(~F.col("sanitised") & F.col("graph_verified")).alias("verified"))
    return by_status.unionByName(of.select(F.explode(F.create_map(F.lit("flow:unsanitised"), "open", F.lit("flow:verified"), "verified")).alias("name", "n")))


def hit_provenance(hits: DataFrame) -> DataFrame:
    """(finding_id, scanners, rules) of the hits behind findings, without blanks, in order."""
    clean = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    return hits.groupBy("finding_id").agg(F.sort_array(F.collect_set(clean("scanner"))).alias("scanners"), F.sort_array(F.collect_set(clean("rule_id"))).alias("rules"))


def related_defaults(matches: DataFrame) -> DataFrame:
    """Related advisories with what is missing filled in: the id that is shown, medium severity,
    contextual evidence, and where the evidence comes from."""
    shown = F.coalesce(*[F.nullif(F.coalesce(c, F.lit("")), F.lit("")) for c in ("display_id", "cve_id", "advisory_id")])
    kind = F.coalesce(*[F.nullif(F.coalesce(c, F.lit("")), F.lit("")) for c in ("match_type", "evidence_type")], F.lit("related_by_cwe"))
    source = F.coalesce(F.nullif(F.coalesce("package_evidence_source", F.lit("")), F.lit("")), F.when(kind == "related_by_cwe", "cwe_correlation"))
    strength = F.coalesce(F.nullif(F.coalesce("evidence_strength", F.lit("")), F.lit("")), F.lit("contextual"))
    return matches.select("id", shown.alias("display_id"), F.coalesce("severity", F.lit("medium")).alias("severity"), kind.alias("evidence_type"), strength.alias("evidence_strength"), source.alias("evidence_source"))
