"""What a scan plans by: budgets, boosts, default picks, coverage, context sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.columns import lookup

# Reads and passes of each scan mode.
READS, PASSES = {"light": 10, "regular": 30, "heavy": 80}, {"light": 1, "regular": 3, "heavy": 6}


def iteration_budget(mode: Column, files: Column, findings: Column) -> Column:
    """(reads, passes) of a scan: more files, more reads, up to twice as many; many findings are worth
    another pass unless the scan is light."""
    scale = F.greatest(F.lit(1.0), F.least(F.lit(2.0), files / 500))
    passes = lookup(mode, PASSES, 3) + F.when((findings > 10) & (mode != "light"), 1).otherwise(0)
    return F.struct(F.floor(lookup(mode, READS, 30) * scale).cast("int").alias("reads"), passes.alias("passes"))


def compaction(window: Column) -> Column:
    """(threshold, target) of tokens at which a context is summarised."""
    return F.struct(F.greatest(F.lit(2000), F.floor(window * 0.3)).cast("int").alias("threshold"), F.greatest(F.lit(1000), F.floor(window * 0.15)).cast("int").alias("target"))


def kept_observations(observations: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The newest observations that stay beside a summary: one for each 30,000 tokens of the model's
    window, two at least and eight at most."""
    many = F.least(F.lit(8), F.greatest(F.lit(2), F.floor(F.col("window") / 30000)))
    newest = Window.partitionBy(*keys).orderBy(F.desc(order))
    return observations.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= many).drop("_n")


def context_size(parts: DataFrame, text_col: str, *keys: str) -> DataFrame:
    return parts.groupBy(*keys).agg(F.sum(text.estimate_tokens(F.col(text_col))).alias("tokens"))


def dependency_boosts(evidence: DataFrame) -> DataFrame:
    """Boost events (file_path, boost) of usage evidence (file, kind)."""
    return evidence.select(F.col("file").alias("file_path"), F.when(F.col("kind") == "vulnerable_function", 6.0).otherwise(4.0).alias("boost"))


def finding_boosts(findings: DataFrame) -> DataFrame:
    """Boost events of findings: 5 for their file, 3 for what looks like a path in their sources."""
    own = findings.select("file_path", F.lit(5.0).alias("boost"))
    words = findings.select(F.explode(F.flatten(F.transform("input_sources", lambda s: F.split(s, r"[\s,;:()'\"]+")))).alias("file_path"))
    return own.unionByName(words.where(F.col("file_path").rlike(r"/[^/]*\.[A-Za-z]+$|^[\w-]+\.[A-Za-z]{1,5}$")).withColumn("boost", F.lit(3.0)))


def default_picks(queue: DataFrame, hot: DataFrame, count: int) -> DataFrame:
    """The first files of the queue, then hot ones, each once."""
    rows = queue.select("file_path", F.lit(0).alias("from"), F.col("place")).unionByName(hot.select("file_path", F.lit(1).alias("from"), F.col("place")))
    best = rows.groupBy("file_path").agg(F.min(F.struct("from", "place")).alias("k"))
    return best.orderBy("k", "file_path").limit(count).select("file_path")


def coverage(files: DataFrame, inspected: DataFrame, runs: DataFrame) -> DataFrame:
    """One row: files, inspected ones, their share, and whether a scanner fell short."""
    seen = files.join(inspected.select("path", F.lit(True).alias("_seen")).distinct(), "path", "left")
    out = seen.agg(F.count("*").alias("files"), F.count("_seen").alias("inspected"))
    state = runs.agg(F.coalesce(F.bool_or(F.col("status").isin("failed", "degraded")), F.lit(False)).alias("degraded_coverage"))
    return out.join(state).withColumn("share", F.round(F.try_divide(F.col("inspected"), F.col("files")), 4))


def files_importing(imports: DataFrame, needle: str, limit: int = 30) -> DataFrame:
    """Files whose imports mention a module or resolve to a file of that name, each at its first line."""
    low = needle.lower()
    hit = F.contains(F.lower("import_module"), F.lit(low)) | F.contains(F.lower(F.coalesce("resolved_path", F.lit(""))), F.lit(low))
    return imports.where(hit).groupBy("source_file").agg(F.min(F.struct("line", "import_module")).alias("m")).select("source_file", "m.line", "m.import_module").orderBy("source_file").limit(limit)


def related_files(edges: DataFrame, file: str, least: float = 0.6, limit: int = 3) -> DataFrame:
    """Neighbours in the call graph (caller_file, callee_file, confidence), the surest first."""
    ends = [edges.where(F.col(a) == file).select(F.col(b).alias("file_path"), "confidence") for a, b in (("caller_file", "callee_file"), ("callee_file", "caller_file"))]
    rows = ends[0].unionByName(ends[1]).where((F.col("confidence") >= least) & (F.col("file_path") != file))
    return rows.groupBy("file_path").agg(F.max("confidence").alias("confidence")).orderBy(F.desc("confidence"), "file_path").limit(limit)


def usage_summary(hits: DataFrame) -> DataFrame:
    """Usage hits (id, kind, file) as a line of text for each dependency."""
    each = hits.groupBy("id", "kind").agg(F.array_join(F.slice(F.sort_array(F.collect_set("file")), 1, 3), ", ").alias("files"))
    label = lookup(F.col("kind"), {"import": "imports", "reference": "references", "vulnerable_function": "vulnerable functions"})
    rank = lookup(F.col("kind"), {"import": 0, "reference": 1, "vulnerable_function": 2})
    line = F.struct(rank.alias("rank"), F.concat_ws(": ", label, "files").alias("line"))
    return each.where(label.isNotNull()).groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(line)), lambda x: x["line"]), "; ").alias("summary"))
