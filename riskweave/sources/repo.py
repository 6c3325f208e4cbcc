"""Source trees as rows of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed, paths
from ..functions.columns import lookup

MOST_BYTES, MOST_FILES = 1_000_000, 10_000

# Extensions of the file index and their languages.
LANGUAGES = {".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".java": "java", ".go": "go", ".rs": "rust", ".rb": "ruby", ".php": "php", ".cs": "csharp", ".kt": "kotlin", ".swift": "swift", ".c": "c", ".cpp": "cpp", ".h": "c", ".scala": "scala", ".dart": "dart", ".ex": "elixir"}
# Files that tell a framework or a tool, and package names that do.
FRAMEWORK_FILES = {"manage.py": "django", "next.config.js": "nextjs", "angular.json": "angular", "Dockerfile": "docker", "docker-compose.yml": "docker", "pom.xml": "maven", "build.gradle": "gradle", "Cargo.toml": "cargo", "go.mod": "go-modules", "Gemfile": "bundler", "composer.json": "composer", "pubspec.yaml": "flutter", "mix.exs": "mix"}
FRAMEWORK_PACKAGES = {"flask": "flask", "django": "django", "fastapi": "fastapi", "express": "express", "react": "react", "vue": "vue", "next": "nextjs", "svelte": "svelte", "koa": "koa", "@nestjs/core": "nestjs"}


def read(spark: SparkSession, root: str) -> DataFrame:
    """Files under a root: path (relative), size_bytes, content. Predicates on path and size reach the
    listing, and content is read only where it is selected."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").split("://")[-1]
    return files.select(F.regexp_replace("path", "^[a-z]+:/*" + base.lstrip("/") + "/|^/*" + base.lstrip("/") + "/", "").alias("path"), F.col("length").alias("size_bytes"), "content")


def text_of(content: Column) -> Column:
    """UTF-8 text; malformed bytes are replaced."""
    return F.make_valid_utf8(content.cast("string"))


def index(files: DataFrame, most_bytes: int = MOST_BYTES, most_files: int = MOST_FILES) -> DataFrame:
    """The files that a scan reads: in no skipped directory, of no binary kind, not too large; the
    first of them by path. Flags say what is a test or a configuration."""
    kept = files.where(~paths.skipped(F.col("path")) & ~paths.is_binary(F.col("path")) & (F.col("size_bytes") <= most_bytes)).orderBy("path").limit(most_files)
    text = text_of(F.col("content"))
    lines = F.when(F.length(text) == 0, 0).otherwise(F.size(F.split(F.regexp_replace(text, "\r?\n$", ""), "\r\n|\n|\r", -1)))
    return kept.select("path", lookup(paths.extension(F.col("path")), LANGUAGES).alias("language"), "size_bytes", lines.alias("line_count"), paths.indexed_as_test(F.col("path")).alias("is_test"), paths.reviewable(F.col("path")).alias("is_config"), text.alias("content"))


def languages(files: DataFrame) -> DataFrame:
    """Languages by number of files, most common first."""
    return files.where("language is not null").groupBy("language").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "language")


def frameworks(files: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Frameworks told by file names and by dependencies."""
    by_file = files.select(lookup(paths.name(F.col("path")), FRAMEWORK_FILES).alias("framework"))
    by_package = dependencies.select(lookup(F.lower("name"), FRAMEWORK_PACKAGES).alias("framework"))
    return by_file.union(by_package).where("framework is not null").distinct()


def tree(files: DataFrame) -> DataFrame:
    """(path, parent, name, is_dir) of all files and their directories."""
    parts = F.split("path", "/")
    made = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, 1, i), "/").alias("path"), (i < F.size(parts)).alias("is_dir")))
    rows = files.select(F.explode(made).alias("x")).select("x.*").distinct()
    return rows.select("path", F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("parent"), paths.name(F.col("path")).alias("name"), "is_dir")


def listing(files: DataFrame, directory: str, limit: int = 100) -> DataFrame:
    """The entries of a directory, directories first."""
    return tree(files).where(F.col("parent") == directory.strip("/")).orderBy(F.desc("is_dir"), F.lower("name")).limit(limit)


def workspaces(files: DataFrame) -> DataFrame:
    """(path, kind) of the packages of a tree; a directory counts with its first kind: by convention
    directory, then nested Python, Go and Node packages."""
    base, home = paths.name(F.col("path")), F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    kind = F.when((base == "package.json") & home.rlike("^(apps|packages|services|libs)/[^/]+$"), F.struct(F.lit(1), F.lit("convention"))).when(base == "pyproject.toml", F.struct(F.lit(2), F.lit("python"))).when(base == "go.mod", F.struct(F.lit(3), F.lit("go"))).when(base == "package.json", F.struct(F.lit(4), F.lit("node")))
    rows = files.select(home.alias("path"), kind.alias("k")).where("k is not null and path <> ''")
    return rows.groupBy("path").agg(F.min("k").alias("k")).select("path", F.col("k.col2").alias("kind"))


def documents(files: DataFrame, limit: int = 15, each: int = 10) -> DataFrame:
    """(path) of the documents to read first: known names in order, other READMEs of the root, then
    the first Markdown files of each directory of documents."""
    path, base = F.col("path"), paths.name(F.col("path"))
    home = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    place = lambda values, c: F.array_position(F.array(*[F.lit(v) for v in values]), c)
    known, directory = place(fixed.DOCUMENTS, path), place(fixed.DOCUMENT_DIRECTORIES, home)
    rows = files.where(~paths.skipped(path)).select("path", base.alias("base"), known.alias("known"), F.when(base.endswith(".md"), directory).otherwise(0).alias("directory"), (~path.contains("/") & F.lower(base).startswith("readme")).alias("readme"))
    rows = rows.where("known > 0 or readme or directory > 0").distinct()
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("directory").orderBy("path")))
    useful = ~F.col("base").isin(*fixed.NO_DOCUMENTS)
    rank = F.when(F.col("known") > 0, F.col("known")).when(F.col("readme") & useful, 100).when((F.col("directory") > 0) & (F.col("r") <= each) & useful, F.col("directory") + 100)
    return rows.withColumn("rank", rank).where("rank is not null").orderBy("rank", "path").limit(limit).select("path")


def source_files(files: DataFrame, most_bytes: int = MOST_BYTES, most_files: int = MOST_FILES) -> DataFrame:
    """The paths that a scan reads, in order: of what is not skipped, binary or too large the first."""
    kept = files.where(~paths.skipped(F.col("path")) & ~paths.is_binary(F.col("path")) & (F.col("size_bytes") <= most_bytes))
    return kept.orderBy("path").limit(most_files).select("path")


def existing(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """Wanted paths with whether the tree has them."""
    there = files.select("path").distinct().withColumn("found", F.lit(True))
    return wanted.join(there, "path", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def readable(path: Column, content: Column, most: int) -> Column:
    """A file's text where its path stays inside the tree and its bytes are few enough; else null."""
    return F.when(paths.is_safe(path) & (F.octet_length(content) <= most), text_of(content))


def ignore_policy(lines: DataFrame) -> DataFrame:
    """(tree_id, kind, pattern): an ignore file's lines (tree_id, line) as prefixes and globs, sorted and
    each once; comments and blanks are left out."""
    pattern = paths.normalise(F.trim("line"))
    rows = lines.where(~F.trim(F.col("line")).startswith("#")).select("tree_id", F.when(pattern.rlike(r"[*?\[\]]"), "glob").otherwise("prefix").alias("kind"), pattern.alias("pattern"))
    return rows.where("pattern <> ''").distinct()


def fingerprint(files: DataFrame, dependencies: DataFrame) -> DataFrame:
    """One row for each tree (tree_id, path, size_bytes; dependencies: tree_id, name): how many files and
    bytes, languages from the most common on, frameworks in order, and whether its size needs a warning."""
    kept = files.where(~paths.skipped(F.col("path"))).withColumn("language", lookup(paths.extension(F.col("path")), LANGUAGES))
    totals = kept.groupBy("tree_id").agg(F.count("*").alias("file_count"), F.sum("size_bytes").alias("total_size"))
    counted = kept.where("language is not null").groupBy("tree_id", "language").agg(F.count("*").alias("n"))
    ranked = counted.groupBy("tree_id").agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("o"), "language"))), lambda x: x["language"]).alias("languages"))
    by_file = kept.select("tree_id", lookup(paths.name(F.col("path")), FRAMEWORK_FILES).alias("framework"))
    by_dir = kept.select("tree_id", F.when(F.concat(F.lit("/"), "path").contains("/k8s/"), "kubernetes").when(F.concat(F.lit("/"), "path").contains("/helm/"), "helm").alias("framework"))
    by_kind = kept.select("tree_id", F.when(paths.extension(F.col("path")).isin(".csproj", ".sln"), "dotnet").alias("framework"))
    by_package = dependencies.select("tree_id", lookup(F.lower("name"), FRAMEWORK_PACKAGES).alias("framework"))
    found = by_file.unionByName(by_dir).unionByName(by_kind).unionByName(by_package).where("framework is not null")
    frameworks = found.groupBy("tree_id").agg(F.sort_array(F.collect_set("framework")).alias("frameworks"))
    out = totals.join(ranked, "tree_id", "left").join(frameworks, "tree_id", "left")
    none = F.array().cast("array<string>")
    return out.select(
        "tree_id", "file_count", "total_size", F.coalesce("languages", none).alias("languages"), F.try_element_at("languages", F.lit(1)).alias("primary_language"),
        F.coalesce("frameworks", none).alias("frameworks"), ((F.col("file_count") > MOST_FILES) | (F.col("total_size") > 500 * MOST_BYTES)).alias("large"),
    )
