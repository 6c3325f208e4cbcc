"""Advisories: OSV records as one row for each package, and their enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores
from ..functions.columns import empty

EVENT = "struct<introduced:string,fixed:string,last_affected:string,limit:string>"
OSV = (
    "id string, aliases array<string>, summary string, details string, published string, modified string, withdrawn string, "
    "severity array<struct<type:string,score:string>>, database_specific struct<severity:string,cwe_ids:array<string>>, "
    f"affected array<struct<package:struct<ecosystem:string,name:string>,ranges:array<struct<type:string,events:array<{EVENT}>>>,versions:array<string>>>, "
    "references array<struct<url:string>>"
)


def range_text(block: Column) -> Column:
    """The constraints of one range, in the order of its events."""
    part = lambda op, v: F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(op), v))
    each = F.transform(block["events"], lambda e: F.array_compact(F.array(part(">=", e["introduced"]), part("<", e["fixed"]), part("<=", e["last_affected"]), part("<", e["limit"]))))
    return F.array_join(F.flatten(each), ",")


def best_cvss(severity: Column) -> Column:
    """(score, vector) of the highest entry; version 4 vectors have no score."""
    value = lambda s: F.when(s["score"].startswith("CVSS:3"), scores.cvss3(s["score"])).when(~s["score"].startswith("CVSS:4"), s["score"].try_cast("double"))
    made = F.transform(severity, lambda s: F.struct(value(s).alias("score"), F.when(s["type"].startswith("CVSS"), s["score"]).alias("vector")))
    known = F.filter(made, lambda x: x["score"].isNotNull())
    top = F.array_max(F.transform(known, lambda x: x["score"]))
    return F.try_element_at(F.filter(known, lambda x: x["score"] == top), F.lit(1))


def from_osv(records: DataFrame) -> DataFrame:
    """One row for each record and package, its affected entries united in order. Withdrawn records
    are left out; a severity without a score is the database's own, else medium."""
    rows = records.where("withdrawn is null").withColumn("_cvss", best_cvss(F.coalesce("severity", F.array().cast("array<struct<type:string,score:string>>"))))
    rows = rows.select("*", F.posexplode("affected").alias("_at", "a")).where("coalesce(a.package.name, '') <> ''")
    windows = F.filter(F.transform(F.filter(F.coalesce("a.ranges", F.array().cast(f"array<struct<type:string,events:array<{EVENT}>>>")), lambda r: F.upper(F.coalesce(r["type"], F.lit(""))) != "GIT"), range_text), lambda x: x != "")
    fixes = F.filter(F.flatten(F.transform(F.filter("a.ranges", lambda r: F.upper(F.coalesce(r["type"], F.lit(""))) != "GIT"), lambda r: F.transform(r["events"], lambda e: e["fixed"]))), lambda x: F.coalesce(x, F.lit("")) != "")
    rows = rows.withColumns({"_w": windows, "_f": F.coalesce(fixes, empty()), "_v": F.filter(F.coalesce("a.versions", empty()), lambda v: v != "")})
    united = lambda c: F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_at", c))), lambda x: x[c])))
    facts = ["aliases", "summary", "details", "published", "modified"]
    out = rows.groupBy("id", F.lower("a.package.ecosystem").alias("ecosystem"), F.col("a.package.name").alias("package")).agg(
        *[F.first(c).alias(c) for c in facts], F.first("_cvss").alias("_cvss"), F.first("database_specific").alias("_db"), F.first("references").alias("_refs"),
        united("_w").alias("affected_ranges"), united("_f").alias("fixed_versions"), united("_v").alias("affected_versions"),
    )
    named = F.lower(F.coalesce("_db.severity", F.lit("medium")))
    named = F.when(named == "moderate", "medium").otherwise(named)
    return out.select(
        "id", "ecosystem", "package", *facts, severity_or(F.col("_cvss.score"), named).alias("severity"), F.col("_cvss.score").alias("cvss_score"), F.col("_cvss.vector").alias("cvss_vector"),
        F.array_join("affected_ranges", " || ").alias("affected_range"), "affected_ranges", "affected_versions", F.try_element_at("fixed_versions", F.lit(1)).alias("fixed_version"), "fixed_versions",
        F.coalesce("_db.cwe_ids", empty()).alias("cwes"), F.array_compact(F.coalesce(F.transform("_refs", lambda r: r["url"]), empty())).alias("references"),
    )


def severity_or(score: Column, fallback: Column) -> Column:
    return scores.severity_of_score(score, fallback)


SYMBOL = "struct<symbol:string,import_path:string,confidence:double,sources:array<string>>"


def enrich(advisories: DataFrame, enrichment: DataFrame) -> DataFrame:
    """Adds functions, symbols and import paths of the enrichment (by id) to those an advisory has."""
    new = enrichment.select("id", F.col("vulnerable_functions").alias("_f"), F.col("vulnerable_symbols").alias("_s"))
    rows = advisories.join(new, "id", "left")
    have = lambda c, t: F.coalesce(F.col(c) if c in advisories.columns else F.lit(None).cast(t), F.array().cast(t))
    symbols = F.concat(have("vulnerable_symbols", f"array<{SYMBOL}>"), F.coalesce("_s", F.array().cast(f"array<{SYMBOL}>")))
    keys = F.transform(symbols, lambda s: F.concat_ws("|", s["symbol"], F.coalesce(s["import_path"], F.lit(""))))
    single = F.filter(symbols, lambda s, i: F.array_position(keys, F.concat_ws("|", s["symbol"], F.coalesce(s["import_path"], F.lit("")))) == i + 1)
    names = F.array_distinct(F.concat(have("vulnerable_functions", "array<string>"), F.coalesce("_f", empty()), F.transform(symbols, lambda s: s["symbol"])))
    return rows.withColumn("vulnerable_symbols", single).withColumn("vulnerable_functions", names).withColumn("vulnerable_import_paths", F.array_distinct(F.array_compact(F.transform("vulnerable_symbols", lambda s: s["import_path"])))).drop("_f", "_s")


def read_osv(spark: SparkSession, path: str) -> DataFrame:
    """OSV records as JSON files, plain or gzip; fields that are missing are null."""
    return spark.read.schema(OSV).option("multiLine", True).option("recursiveFileLookup", True).json(path)


def write_advisories(advisories: DataFrame, path: str) -> None:
    """By ecosystem, so that a scan reads those of its own languages only."""
    advisories.write.mode("overwrite").partitionBy("ecosystem").parquet(path)


def text_symbols(advisories: DataFrame) -> DataFrame:
    """(id, symbol, sources, confidence) of the functions that advisories' texts name."""
    from ..functions import mining

    both = F.concat(mining.text_symbols(F.col("summary"), "summary"), mining.text_symbols(F.col("details"), "details"))
    rows = advisories.select("id", F.explode(both).alias("s")).select("id", "s.symbol", "s.source")
    out = rows.groupBy("id", "symbol").agg(F.sort_array(F.collect_set("source")).alias("sources"))
    return out.withColumn("confidence", mining.symbol_confidence(F.col("sources")))


#: What an ecosystem says itself about what is vulnerable.
SPECIFIC = "struct<affected_functions:array<string>,imports:array<struct<path:string,module:string,modules:array<string>,paths:array<string>,symbols:array<string>,affected_functions:array<string>,attributes:array<string>,attribute:string,name:string,symbol:string>>>"


def structured_symbols(affected: DataFrame) -> DataFrame:
    """(id, symbol, import_path, sources, confidence) of affected entries (id, specific): functions, and
    every symbol of an import under every path of it. A path makes it certain."""
    from ..functions import mining

    none = lambda c: F.coalesce(c, empty())
    one = lambda c: F.array_compact(F.array(c))
    paths = lambda i: F.array_sort(F.array_distinct(F.array_compact(F.transform(F.concat(none(i["modules"]), none(i["paths"]), one(i["path"]), one(i["module"])), mining.import_path))))
    named = lambda i: F.filter(F.concat(none(i["symbols"]), none(i["affected_functions"]), none(i["attributes"]), one(i["attribute"])), lambda s: F.trim(s) != "")
    other = lambda i: F.filter(one(F.coalesce(F.nullif(i["name"], F.lit("")), i["symbol"])), lambda s: F.trim(s) != "")
    symbols = lambda i: F.when(F.size(named(i)) > 0, named(i)).otherwise(other(i))
    where = lambda i: F.when(F.size(paths(i)) > 0, paths(i)).otherwise(F.array(F.lit(None).cast("string")))
    direct = affected.select("id", F.explode(none(F.col("specific.affected_functions"))).alias("token")).select("id", "token", F.lit(None).cast("string").alias("import_path"), F.lit("ecosystem_specific.affected_functions").alias("source"), F.lit(1.0).alias("confidence"))
    each = affected.select("id", F.explode(F.col("specific.imports")).alias("i")).select("id", F.explode(symbols(F.col("i"))).alias("token"), where(F.col("i")).alias("at")).select("id", "token", F.explode_outer("at").alias("import_path"))
    each = each.select("id", "token", "import_path", F.lit("ecosystem_specific.imports").alias("source"), F.when(F.col("import_path").isNull(), 0.95).otherwise(1.0).alias("confidence"))
    rows = direct.unionByName(each).withColumn("symbol", mining.candidate(F.col("token"), F.lit(True))).where("symbol is not null")
    return dedupe_symbols(rows)


def dedupe_symbols(rows: DataFrame) -> DataFrame:
    """Symbols of an advisory (id, symbol, import_path, source, confidence), each once: sources united,
    the highest confidence."""
    return rows.groupBy("id", "symbol", "import_path").agg(F.sort_array(F.collect_set("source")).alias("sources"), F.max("confidence").alias("confidence"))


def enrichment_stats(advisories: DataFrame, mined: DataFrame) -> DataFrame:
    """One row: how many advisories (id, vulnerable_functions) gain functions from what was mined (id,
    symbol), and how many functions that are."""
    known = advisories.select("id", F.explode("vulnerable_functions").alias("symbol"))
    new = mined.select("id", "symbol").distinct().join(known, ["id", "symbol"], "left_anti")
    return new.agg(F.count_distinct("id").alias("enriched"), F.count("*").alias("functions"))


def read_shards(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Advisories under ``<root>/ecosystem=<name>/``, one JSON array or object for each file, plain or
    gzip; files that do not parse give no row. Partitions are pruned by ecosystem."""
    rows = spark.read.schema(schema + ", _corrupt string").option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").option("pathGlobFilter", "advisories.json*").json(root)
    return rows.where("_corrupt is null").drop("_corrupt")


def enrichment_rows(payloads: DataFrame) -> DataFrame:
    """Enrichment payloads (payload: JSON with a map under ``advisories``) as rows by id; anything else
    gives none."""
    entry = f"struct<vulnerable_functions:array<string>,vulnerable_symbols:array<{SYMBOL}>,sources:array<string>>"
    parsed = F.from_json("payload", f"struct<advisories:map<string,{entry}>>")
    return payloads.select(F.explode(parsed["advisories"]).alias("id", "e")).where("e is not null").select("id", "e.*")


def parsed(payloads: DataFrame, schema: str) -> DataFrame:
    """JSON texts (payload) as rows of a schema; those that do not parse give no row."""
    read = F.from_json("payload", schema + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    return payloads.select(read.alias("r")).where("r._corrupt is null and r is not null").select("r.*").drop("_corrupt")


def version_of(texts: DataFrame) -> DataFrame:
    """The version that a stamp file (value) holds: its first line, trimmed."""
    return texts.select(F.trim(F.substring_index("value", "\n", 1)).alias("version"))
