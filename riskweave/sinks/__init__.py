"""Exports: bills of materials, evidence rows, JSON artifacts, and deletes by rewriting."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import shared_folder

# Package URL types of the ecosystems.
PURL = {"npm": "npm", "pypi": "pypi", "maven": "maven", "go": "golang", "crates.io": "cargo", "rubygems": "gem", "nuget": "nuget", "packagist": "composer", "pub": "pub", "hex": "hex"}


def cyclonedx(components: DataFrame) -> DataFrame:
    """One JSON text (column component) for each component of a bill of materials."""
    from ..functions.columns import lookup

    purl = F.concat(F.lit("pkg:"), lookup(F.col("ecosystem"), PURL, "generic"), F.lit("/"), F.replace("name", F.lit(":"), F.lit("/")), F.lit("@"), F.col("version"))
    scope = F.when(F.col("is_dev"), "optional").otherwise("required")
    return components.select(F.to_json(F.struct(F.lit("library").alias("type"), "name", "version", purl.alias("purl"), scope.alias("scope"), F.col("vulnerabilities"))).alias("component"))


def evidence_rows(findings: DataFrame) -> DataFrame:
    """(finding_id, kind, ordinal, description) of supporting and opposing evidence."""
    rows = [findings.select("finding_id", F.lit(kind).alias("kind"), F.posexplode(f"{kind}_evidence").alias("ordinal", "description")) for kind in ("supporting", "opposing")]
    return rows[0].unionByName(rows[1])


def _apart(df: DataFrame, path: str) -> None:
    """A table must not be written over what it is read from."""
    target = path.rstrip("/").split("://")[-1].split(":")[-1].rstrip("/")
    if any(f.split("://")[-1].split(":")[-1].startswith(target + "/") for f in df.inputFiles()):
        raise ValueError(f"{path} is read by what is written to it")


def write_json(df: DataFrame, path: str, compressed: bool = False, by: tuple[str, ...] = ()) -> None:
    _apart(df, path)
    writer = df.write.mode("overwrite").option("compression", "gzip" if compressed else "none")
    (writer.partitionBy(*by) if by else writer).json(path)


def write_report(df: DataFrame, path: str, *by: str) -> None:
    _apart(df, path)
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def round_trip(df: DataFrame, kind: str, *by: str) -> DataFrame:
    """Writes an artifact into the folder that the cluster shares and reads it again; it goes when the
    driver's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/artifact-{uuid.uuid4().hex}"
    if kind == "json":
        write_json(df, path, compressed=True, by=by)
    else:
        write_report(df, path, *by)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).format(kind).load(path)


def without_scan(tables: dict[str, DataFrame], scan_ids: DataFrame) -> dict[str, DataFrame]:
    """All tables without the rows of the given scans; the delete is a rewrite of what stays."""
    return {name: df.join(scan_ids.select("scan_id"), "scan_id", "left_anti") for name, df in tables.items()}
