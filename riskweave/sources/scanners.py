"""Scanner output as hits: (scanner, rule_id, severity, message, file_path, start_line, end_line,
snippet, metadata). Reports are rows (report), one JSON text each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, paths
from ..functions.columns import lookup
from ..functions.scores import severity_of_score

SEMGREP = "results array<struct<check_id:string,path:string,start:struct<line:int>,end:struct<line:int>,extra:struct<message:string,severity:string,lines:string,metadata:map<string,string>>>>"
BANDIT = "results array<struct<test_id:string,issue_severity:string,issue_text:string,filename:string,line_number:int,line_range:array<int>,code:string,issue_confidence:string>>"
ESLINT = "array<struct<filePath:string,messages:array<struct<ruleId:string,severity:string,message:string,line:int,endLine:int>>>>"
PLACE = "struct<artifactLocation:struct<uri:string>,region:struct<startLine:int,endLine:int,snippet:struct<text:string>>>"
SARIF = (
    "runs array<struct<results:array<struct<ruleId:string,level:string,message:struct<text:string>,"
    f"locations:array<struct<physicalLocation:{PLACE}>>,properties:struct<`security-severity`:string,tags:array<string>>,"
    f"codeFlows:array<struct<threadFlows:array<struct<locations:array<struct<location:struct<physicalLocation:{PLACE},message:struct<text:string>>>>>>>>,"
    "fingerprints:map<string,string>,partialFingerprints:map<string,string>>>>>"
)


def _hits(rows: DataFrame, **columns: Column) -> DataFrame:
    return rows.select(*[c.alias(n) for n, c in columns.items()])


def semgrep(reports: DataFrame) -> DataFrame:
    r = reports.select(F.explode(F.from_json("report", SEMGREP)["results"]).alias("r"))
    level = lookup(F.col("r.extra.severity"), fixed.SEMGREP_SEVERITY, "low")
    return _hits(r, scanner=F.lit("semgrep"), rule_id=F.col("r.check_id"), severity=level, message=F.col("r.extra.message"), file_path=paths.normalise(F.col("r.path")), start_line=F.col("r.start.line"), end_line=F.col("r.end.line"), snippet=F.col("r.extra.lines"), metadata=F.to_json("r.extra.metadata"))


def bandit(reports: DataFrame) -> DataFrame:
    r = reports.select(F.explode(F.from_json("report", BANDIT)["results"]).alias("r"))
    last = F.coalesce(F.try_element_at("r.line_range", F.lit(-1)), F.col("r.line_number"))
    return _hits(r, scanner=F.lit("bandit"), rule_id=F.col("r.test_id"), severity=lookup(F.col("r.issue_severity"), fixed.BANDIT_SEVERITY, "low"), message=F.col("r.issue_text"), file_path=paths.normalise(F.col("r.filename")), start_line=F.col("r.line_number"), end_line=last, snippet=F.col("r.code"), metadata=F.to_json(F.struct(F.col("r.issue_confidence").alias("confidence"))))


def eslint(reports: DataFrame) -> DataFrame:
    files = reports.select(F.explode(F.from_json("report", ESLINT)).alias("f"))
    r = files.select("f.filePath", F.explode("f.messages").alias("m"))
    return _hits(r, scanner=F.lit("eslint"), rule_id=F.coalesce("m.ruleId", F.lit("parse-error")), severity=lookup(F.col("m.severity"), fixed.ESLINT_SEVERITY, "info"), message=F.col("m.message"), file_path=paths.normalise(F.col("filePath")), start_line=F.col("m.line"), end_line=F.col("m.endLine"), snippet=F.lit(None).cast("string"), metadata=F.lit(None).cast("string"))


def _local(uri: Column) -> Column:
    return paths.normalise(F.regexp_replace(F.coalesce(uri, F.lit("")), "^file:///?", ""))


def sarif(reports: DataFrame) -> DataFrame:
    """CodeQL results; metadata are columns, for they are merged: cwes, tags, steps, fingerprint."""
    runs = reports.select(*[c for c in reports.columns if c != "report"], F.explode(F.from_json("report", SARIF)["runs"]).alias("run"))
    r = runs.select("*", F.explode("run.results").alias("r"))
    place = F.try_element_at("r.locations", F.lit(1))["physicalLocation"]
    score = F.col("r.properties.security-severity")
    by_level = lookup(F.coalesce("r.level", F.lit("warning")), fixed.SARIF_LEVEL, "medium")
    severity = F.when(score.try_cast("double").isNotNull(), severity_of_score(score.try_cast("double"))).otherwise(by_level)
    steps = F.try_element_at(F.try_element_at("r.codeFlows", F.lit(1))["threadFlows"], F.lit(1))["locations"]
    step = lambda s: F.struct(_local(s["location"]["physicalLocation"]["artifactLocation"]["uri"]).alias("file"), F.coalesce(s["location"]["physicalLocation"]["region"]["startLine"], F.lit(0)).alias("line"), F.substring(F.coalesce(s["location"]["message"]["text"], F.lit("")), 1, 100).alias("message"))
    prints = F.coalesce(F.when(F.size("r.fingerprints") > 0, F.col("r.fingerprints")), F.col("r.partialFingerprints"))
    pairs = F.array_sort(F.filter(F.map_entries(prints), lambda e: F.coalesce(e["value"], F.lit("")) != ""))
    tags = F.coalesce("r.properties.tags", F.array().cast("array<string>"))
    keep = {c: F.col(c) for c in reports.columns if c != "report"}
    return _hits(
        r,
        **keep,
        scanner=F.lit("codeql"),
        rule_id=F.concat(F.lit("codeql/"), F.coalesce("r.ruleId", F.lit("unknown"))),
        severity=severity,
        message=F.substring(F.coalesce("r.message.text", F.lit("")), 1, 500),
        file_path=_local(place["artifactLocation"]["uri"]),
        start_line=F.coalesce(place["region"]["startLine"], F.lit(0)),
        end_line=place["region"]["endLine"],
        snippet=F.substring(F.coalesce(place["region"]["snippet"]["text"], F.lit("")), 1, 300),
        cwes=F.filter(tags, lambda t: t.startswith("external/cwe/")),
        tags=tags,
        steps=F.slice(F.coalesce(F.transform(steps, step), F.array().cast("array<struct<file:string,line:int,message:string>>")), 1, 10),
        fingerprint=F.array_join(F.transform(pairs, lambda e: F.concat_ws("=", e["key"], e["value"])), "|"),
    )


def dedupe(hits: DataFrame, order: str = "ordinal") -> DataFrame:
    """SARIF hits of one fingerprint (or one rule, place and message) as one: the first hit's values,
    suites, tags and weaknesses united, data-flow steps of the first that has any."""
    key = F.coalesce(F.nullif(F.col("fingerprint"), F.lit("")), F.concat_ws("|", "rule_id", "file_path", F.col("start_line").cast("string"), F.coalesce("end_line", F.lit(0)).cast("string"), "message"))
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    first = ["rule_id", "severity", "message", "file_path", "start_line", "end_line", "snippet"]
    out = hits.groupBy(key.alias("key")).agg(
        F.min_by(F.struct(*first), F.col(order)).alias("h"), *[union(c) for c in ("suites", "tags", "cwes") if c in hits.columns],
        F.min_by(F.when(F.size("steps") > 0, F.col("steps")), F.when(F.size("steps") > 0, F.col(order))).alias("steps"),
    )
    return out.select("h.*", *[c for c in ("suites", "tags", "cwes") if c in hits.columns], "steps", F.coalesce(F.size("steps") > 0, F.lit(False)).alias("has_data_flow"))
