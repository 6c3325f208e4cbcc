"""Joins between the domain's tables. Prefixes, suffixes, aliases and keys are exploded, so that
what looks like a theta join is a join by equality."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import packages, paths, text
from ..functions.versions import version_in_range
from . import products


def with_default_counts(left: DataFrame, right: DataFrame, key: str, name: str = "n") -> DataFrame:
    """Rows with the number of rows of another table for their key, 0 where there is none."""
    counts = right.groupBy(key).agg(F.count("*").alias(name))
    return left.join(counts, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def advisory_keys(advisories: DataFrame) -> DataFrame:
    """One row for each advisory and key of its package."""
    return advisories.withColumn("key", F.explode(packages.index_keys(F.col("package"), F.col("ecosystem"))))


PRIORITY = {packages.EXACT: 3, packages.CANONICAL: 2, packages.ARTIFACT: 1}


def audit(dependencies: DataFrame, advisories: DataFrame) -> DataFrame:
    """Dependencies (id, ecosystem, name, version) with the advisories that affect them: keys of both
    sides meet, the version is tested, and the best kind of match of each advisory stays.

    Versions and advisories are read once each, into keys in the order of versions; a pair is then a
    comparison of keys. Names meet packages, and names and versions meet advisories, once each, however many
    dependencies have them; the product of dependencies and advisories is made last and shuffled nowhere."""
    from ..functions import versionkeys
    from ..functions.columns import lookup

    low = dependencies.withColumn("ecosystem", F.lower("ecosystem"))
    each = low.groupBy("id").agg(F.sort_array(F.collect_set(F.struct("ecosystem", "name", "version"))).alias("_is"))
    what = each.select("_is").distinct().withColumn("r", F.explode("_is")).select("_is", "r.*")
    wanted = what.select("ecosystem", "name").distinct()
    probes = wanted.withColumn("k", F.explode(packages.lookup_keys(F.col("name"), F.col("ecosystem")))).select("ecosystem", "name", "k.key", "k.match_type")
    given = advisories.withColumn("ecosystem", F.lower("ecosystem")).withColumnRenamed("id", "advisory_id")
    built = advisory_keys(given.select("ecosystem", "package").distinct())
    better = F.struct((-lookup(F.col("match_type"), PRIORITY, 0)).alias("place"), "key", "match_type")
    met = probes.join(built, ["ecosystem", "key"]).groupBy("ecosystem", "name", "package").agg(F.min(better).alias("how"))
    pairs = met.join(given.select("ecosystem", "package", "advisory_id"), ["ecosystem", "package"]).groupBy("ecosystem", "name", "advisory_id").agg(F.min("how").alias("how"))
    bounds = versionkeys.advisory_bounds(given.select("advisory_id", "ecosystem", "affected_ranges", "affected_range", "affected_versions").dropDuplicates(["advisory_id"]))
    keys = versionkeys.version_keys(what)
    meant = what.join(pairs, ["ecosystem", "name"])
    tested = meant.select("version", "advisory_id").distinct().join(bounds, "advisory_id").join(keys.select("version", F.struct(*[c for c in keys.columns if c != "version"]).alias("v")), "version")
    holds = tested.where(versionkeys.affected(F.col("v"), F.col("ranges"), F.col("listed"))).select("version", "advisory_id")
    first = F.min(F.struct("how", "name", "version", "ecosystem")).alias("b")
    best = meant.join(holds, ["version", "advisory_id"]).groupBy("_is", "advisory_id").agg(first)
    facts = advisories.select(F.col("id").alias("advisory_id"), F.lower(F.coalesce("severity", F.lit("medium"))).alias("severity"), F.substring("details", 1, 500).alias("details"), F.slice("references", 1, 3).alias("references"))
    told = F.struct("advisory_id", "b.ecosystem", "b.name", "b.version", "b.how.match_type", "severity", "details", "references")
    return products.paired(each, best.join(facts, "advisory_id").select("_is", told.alias("_a")), ["_is"], "_a").select("id", "_a.*")


def in_affected_range(versions: DataFrame, ranges: DataFrame, key: str) -> DataFrame:
    """Range join on a key with the version test as the residual."""
    return versions.join(ranges, key).where(version_in_range("version", "affected_range", "ecosystem"))


def imports_of_packages(dependencies: DataFrame, imports: DataFrame) -> DataFrame:
    """External imports (source_file, import_module) with the dependencies they may mean, best alias
    of each: aliases meet the import's prefixes by equality, then the pair is scored.

    Names and modules are met and scored once each; the product of the imports of a module and the
    dependencies of its names is made last and shuffled nowhere."""
    outside = imports.where("is_external").select("source_file", "import_module", "line").distinct()
    named = dependencies.select("id", F.col("name").alias("package"), "ecosystem").distinct()
    ids = packages_of_modules(named, outside).join(named, ["package", "ecosystem"])
    beside = ["package", "ecosystem", "confidence", "kind", "alias"]
    meant = ids.select("import_module", "id", "package", "ecosystem", F.round("m.confidence", 2).alias("confidence"), "m.kind", "m.alias")
    return products.paired(outside, meant, ["import_module"], "id", *beside).select("id", "source_file", "import_module", "line", "confidence", "kind", "alias")


def packages_of_modules(named: DataFrame, imports: DataFrame) -> DataFrame:
    """(package, ecosystem, import_module, m): the modules that may mean a package, scored. Each distinct package
    and module meet by equality of an alias with a beginning of the module."""
    alias = named.select("package", "ecosystem").distinct().withColumn("alias", F.explode(packages.import_aliases(F.col("package"), F.col("ecosystem"))))
    begins = imports.select("import_module").distinct().withColumn("alias", F.explode(packages.import_reach(F.col("import_module"))))
    pairs = begins.join(alias, "alias").select("package", "ecosystem", "import_module").distinct()
    return pairs.withColumn("m", packages.import_match(F.col("package"), F.col("ecosystem"), F.col("import_module"))).where("m is not null")


def function_index(advisories: DataFrame, cap: int | None = None) -> DataFrame:
    """(function, advisory_id, ...) of vulnerable functions; with a cap, of a function the first so
    many advisories in order (the studied system keeps 20)."""
    rows = advisories.select(F.explode("vulnerable_functions").alias("symbol"), F.col("id").alias("advisory_id"), "package", F.lower("ecosystem").alias("ecosystem"), "severity")
    keys = rows.withColumn("function", F.explode(packages.function_keys(F.col("symbol")))).dropDuplicates(["function", "advisory_id"]).drop("symbol")
    if cap is None:
        return keys
    w = Window.partitionBy("function").orderBy("ecosystem", "advisory_id")
    return keys.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= cap).drop("_r")


def vulnerable_calls(calls: DataFrame, index: DataFrame, imports: DataFrame, dependencies: DataFrame, limit: int = 10) -> DataFrame:
    """Calls (file, function, line) of functions that advisories name. Packages and modules meet once each by
    equality of names, not in each file. Evidence is strong where the
    file imports the package and it is a vulnerable dependency, medium where it is imported, else
    weak; an advisory counts once for a file, at its best and first call."""
    hits = calls.withColumn("function", F.lower("function")).join(index, "function")
    outside = imports.where("is_external").select(F.col("source_file").alias("file"), "import_module").distinct()
    meant = packages_of_modules(index, outside).groupBy("import_module", "package", "ecosystem").agg(F.max("m.confidence").alias("confidence"))
    told = outside.join(meant, "import_module").groupBy("file", "package", "ecosystem").agg(F.max("confidence").alias("confidence"))
    sure = hits.select("file", "advisory_id", "package", "ecosystem").distinct().join(told, ["file", "package", "ecosystem"])
    sure = sure.groupBy("file", "advisory_id").agg(F.max("confidence").alias("import_confidence"))
    low = dependencies.withColumn("ecosystem", F.lower("ecosystem"))
    owned = low.select("ecosystem", F.explode(packages.index_keys(F.col("name"), F.col("ecosystem"))).alias("key")).distinct()
    known = index.select("advisory_id", "ecosystem", F.explode(packages.index_keys(F.col("package"), F.col("ecosystem"))).alias("key")).join(owned, ["ecosystem", "key"], "left_semi").select("advisory_id").distinct()
    out = hits.join(sure, ["file", "advisory_id"], "left").join(known.withColumn("_known", F.lit(True)), "advisory_id", "left")
    strength = F.when(F.col("import_confidence").isNotNull() & F.col("_known"), 3).when(F.col("import_confidence").isNotNull(), 2).otherwise(1)
    kind = F.when(strength == 3, "confirmed_vulnerable_dependency_function_match").when(strength == 2, "import_confirmed_function_match").otherwise("function_name_match")
    out = out.withColumn("strength", strength).withColumn("evidence_type", kind).withColumn("evidence_strength", F.element_at(F.array(F.lit("weak"), F.lit("medium"), F.lit("strong")), F.col("strength")))
    one = Window.partitionBy("file", "advisory_id").orderBy(F.desc("strength"), F.desc_nulls_last("import_confidence"), "line", "function")
    few = Window.partitionBy("file").orderBy(F.desc("strength"), F.desc_nulls_last("import_confidence"), "line", "advisory_id")
    out = out.withColumn("_r", F.row_number().over(one)).where("_r = 1").withColumn("_r", F.row_number().over(few)).where(F.col("_r") <= limit)
    return out.select("file", "function", "line", "advisory_id", "package", "ecosystem", "severity", "evidence_type", "evidence_strength")


def by_weakness(findings: DataFrame, advisories: DataFrame, limit: int = 5, cap: int | None = None) -> DataFrame:
    """Advisories that share a weakness with a finding, in the order of the finding's weaknesses. With
    a cap, of a weakness the first advisories of each ecosystem (the studied system keeps 10).

    Without one, a finding's best are looked for in each weakness's first ``limit`` advisories only:
    of the advisories under one weakness no later one can be among a finding's first ``limit``, unless
    an earlier weakness of the finding has it already, in which case it counts there."""
    index = advisories.select(F.explode("cwes").alias("cwe"), F.lower("ecosystem").alias("ecosystem"), F.col("id").alias("advisory_id")).distinct()
    if cap is not None:
        w = Window.partitionBy("cwe", "ecosystem").orderBy("advisory_id")
        index = index.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= cap).drop("_r")
    rows = findings.select("finding_id", F.posexplode("cwe_ids").alias("place", "cwe"))
    most = rows.agg(F.max("place")).first()[0]
    # under the n-th weakness the first n * limit suffice: limit of them stand under no earlier one
    first_few = Window.partitionBy("cwe").orderBy("advisory_id")
    named = index.select("cwe", "advisory_id").distinct().withColumn("_r", F.row_number().over(first_few)).where(F.col("_r") <= limit * ((most or 0) + 1)).drop("_r")
    first = rows.join(named, "cwe").groupBy("finding_id", "advisory_id").agg(F.min("place").alias("place"))
    order = Window.partitionBy("finding_id").orderBy("place", "advisory_id")
    return first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


#: Languages with rules of their own; others are resolved by file names.
RESOLVED = ("python", "javascript", "typescript", "java", "kotlin", "go", "ruby", "php", "rust")


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Imports (id, source_file, module, language) to files (path): candidate paths of the language
    in order, the first that exists. Suffix rules take the least path of several; a Go module is the
    directory of its last part, a name without a path the only file of that name."""
    m, src = F.col("module"), F.col("source_file")
    parent = F.regexp_extract(src, "^(.*/)?[^/]*$", 1)
    stem = F.when(F.col("language").isin("python", "java", "kotlin"), F.replace(m, F.lit("."), F.lit("/"))).otherwise(m)
    up = F.regexp_replace(stem, "/[^/]*$", "")
    option = lambda p, c, is_dir=False: F.struct(p.alias("path"), F.lit(c).alias("confidence"), F.lit(is_dir).alias("is_dir"))
    python = F.array(option(F.concat(stem, F.lit(".py")), 1.0), option(F.concat(stem, F.lit(".pyi")), 1.0), option(F.concat(stem, F.lit("/__init__.py")), 0.9), option(F.concat(up, F.lit(".py")), 0.8), option(F.concat(up, F.lit("/__init__.py")), 0.7))
    # relative modules: dots climb from the source's directory, ./ and ../ are resolved by segments
    dots = F.length(F.regexp_extract(m, r"^(\.*)", 1))
    home = F.filter(F.split(parent, "/"), lambda x: x != "")
    climbed = F.array_join(F.slice(home, F.lit(1), F.greatest(F.size(home) - dots + 1, F.lit(0))), "/")
    tail = F.replace(F.regexp_replace(m, r"^\.+", ""), F.lit("."), F.lit("/"))
    rel = F.concat_ws("/", F.nullif(climbed, F.lit("")), F.nullif(tail, F.lit("")))
    relative = F.array(option(F.concat(rel, F.lit(".py")), 1.0), option(F.concat(rel, F.lit("/__init__.py")), 0.9))

    def settle(s, p):
        return F.when(p == "..", F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0)))).otherwise(F.array_append(s, p))

    raw = F.filter(F.split(F.concat(parent, m), "/"), lambda x: ~x.isin("", "."))
    base = F.array_join(F.aggregate(raw, F.array().cast("array<string>"), settle), "/")
    script = F.array(*[option(F.concat(base, F.lit(e)), 1.0) for e in (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")], *[option(F.concat(base, F.lit(f"/index{e}")), 0.9) for e in (".ts", ".tsx", ".js", ".jsx")], option(base, 1.0))
    own = F.when((F.col("language") == "python") & m.startswith("."), relative).when(F.col("language") == "python", python)
    own = own.when(F.col("language").isin("javascript", "typescript") & m.rlike(r"^[./]"), script)
    crate = F.replace(F.regexp_replace(m, "^(crate|super)::", ""), F.lit("::"), F.lit("/"))
    above = F.regexp_replace(F.regexp_extract(parent, "^(.*/)?[^/]+/$", 1), "/$", "")
    rust = F.array(*[option(F.concat(F.lit(at), crate, F.lit(end)), c) for at in ("src/", "") for end, c in ((".rs", 0.9), ("/mod.rs", 0.8))])
    own = own.when((F.col("language") == "rust") & m.startswith("crate::"), rust)
    own = own.when((F.col("language") == "rust") & m.startswith("super::"), F.array(option(F.concat_ws("/", F.nullif(above, F.lit("")), F.concat(crate, F.lit(".rs"))), 0.9)))
    own = own.when((F.col("language") == "ruby") & m.rlike(r"^\.\.?/"), F.array(option(F.concat(base, F.lit(".rb")), 1.0), option(base, 1.0)))
    own = own.when(F.col("language").isin("java", "kotlin") & m.endswith(".*"), F.array(option(F.regexp_replace(stem, r"/\*$", ""), 0.7, True)))
    own = own.otherwise(F.array().cast("array<struct<path:string,confidence:double,is_dir:boolean>>"))
    levels = F.split(F.col("path"), "/")
    above_file = F.when(F.size(levels) > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.size(levels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(levels, 1, i), "/"))).otherwise(F.array().cast("array<string>"))
    dirs = files.select(F.explode(above_file).alias("path")).distinct()
    there = files.select("path", F.lit(False).alias("is_dir")).union(dirs.select("path", F.lit(True)))
    exact = imports.select("id", F.posexplode(own).alias("place", "o")).select("id", "place", "o.*").join(there, ["path", "is_dir"])
    best = exact.groupBy("id").agg(F.min_by(F.struct("path", "confidence"), "place").alias("x"))
    # suffixes of the files meet the module's path by equality
    parts = F.split(F.col("path"), "/")
    suffixes = files.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("suffix"))
    ends = {"java": [".java"], "kotlin": [".kt", ".java"], "php": [".php"]}
    wanted = F.when(F.col("language") == "php", F.replace(m, F.lit("\\"), F.lit("/"))).otherwise(stem)
    by_suffix = None
    for language, kinds in ends.items():
        for place, end in enumerate(kinds):
            rows = imports.where(F.col("language") == language).select("id", F.concat(wanted, F.lit(end)).alias("suffix"), F.lit(place).alias("place"), F.lit(0.8 if language == "php" else 0.9).alias("confidence"))
            by_suffix = rows if by_suffix is None else by_suffix.unionByName(rows)
    tails = by_suffix.join(suffixes, "suffix").groupBy("id").agg(F.min_by(F.struct("path", "confidence"), F.struct("place", "path")).alias("y"))
    # a Go module ends in its directory's name; each distinct module meets the directories once
    last = F.element_at(F.split(F.btrim(m, F.lit('"')), "/"), -1)
    homes = dirs.select(F.col("path").alias("home"), F.element_at(F.split("path", "/"), -1).alias("last"))
    modules = imports.where("language = 'go'").select("module", last.alias("last")).distinct().join(homes, "last")
    modules = modules.groupBy("module").agg(F.min_by("home", F.struct(~F.col("module").endswith(F.concat(F.lit("/"), F.col("home"))), F.col("home"))).alias("home"))
    # names: a Ruby module's own, else the last part of any other language's, with the endings in order
    named = F.when(F.col("language") == "ruby", F.array(F.struct(F.concat(m, F.lit(".rb")).alias("base"), F.lit(0.6).alias("confidence"))))
    word = F.element_at(F.split(m, r"\.|/|::"), -1)
    named = named.when(~F.col("language").isin(*RESOLVED), F.array(*[F.struct(F.concat(word, F.lit(e)).alias("base"), F.lit(0.4).alias("confidence")) for e in (".py", ".js", ".ts", ".java", ".go", ".rs", ".rb", ".php")]))
    single = files.groupBy(paths.name(F.col("path")).alias("base")).agg(F.count("*").alias("n"), F.min("path").alias("path")).where("n = 1").drop("n")
    names = imports.where("language <> 'go'").select("id", F.posexplode(named).alias("place", "o")).select("id", "place", "o.*").join(single, "base")
    names = names.groupBy("id").agg(F.min_by(F.struct("path", "confidence"), "place").alias("z"))
    out = imports.join(best, "id", "left").join(tails, "id", "left").join(names, "id", "left").join(modules.withColumn("language", F.lit("go")), ["language", "module"], "left")
    hit = F.coalesce("x", "y", "z", F.when(F.col("home").isNotNull(), F.struct(F.col("home").alias("path"), F.lit(0.7).alias("confidence"))))
    outside = ~((F.col("language") == "python") & m.startswith(".") | F.col("language").isin("javascript", "typescript") & m.rlike(r"^[./]"))
    return out.select("id", hit["path"].alias("resolved_path"), F.coalesce(hit["confidence"], F.when(outside, 0.0).when(F.col("language") == "python", 0.3).otherwise(0.2)).alias("confidence"), (hit.isNull() & outside).alias("is_external"))


def enclosing_symbols(lines: DataFrame, symbols: DataFrame, limit: int = 1) -> DataFrame:
    """Lines (line_id, file, line) to the narrowest symbols (file, name, start_line, end_line) around
    them. A line meets the blocks of the symbols that hold it, and of a block's symbols the first few, so
    a file of very many lines and symbols is no product."""
    from . import intervals

    order = lambda: [F.col("end_line") - F.col("start_line"), F.desc("start_line"), F.col("name")]
    narrow = intervals.first_of(intervals.in_blocks(symbols, F.col("start_line"), F.col("end_line")), ["file"], order(), limit)
    most = intervals.top(symbols, F.col("start_line"), F.col("end_line"))
    rows = intervals.at_place(lines, F.col("line"), most).join(narrow, ["file", *intervals.KEYS]).drop(*intervals.KEYS)
    w = Window.partitionBy("line_id").orderBy(*order())
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def link_by_content(findings: DataFrame, files: DataFrame, least: int = 15) -> DataFrame:
    """(finding_id, file_id): a finding's first telling snippet line to the first file that has that
    line. Lines are trimmed and compared whole, by equality; each line has its first file before findings meet
    it, so lines that many have are no product."""
    telling = lambda x: (F.length(x) > least) & ~x.rlike(r"^(#|//|/\*|\*)")
    trimmed = lambda c: F.transform(F.split(c, "\n", -1), lambda x: F.btrim(x, F.lit(" \t\r")))
    wanted = findings.select("finding_id", F.try_element_at(F.filter(trimmed("code_snippet"), telling), F.lit(1)).alias("content")).where("content is not null")
    lines = files.select("file_id", F.explode(F.array_distinct(F.filter(trimmed("content"), telling))).alias("content"))
    first = lines.groupBy("content").agg(F.min("file_id").alias("file_id"))
    return wanted.join(first, "content").groupBy("finding_id").agg(F.min("file_id").alias("file_id"))


def unique_basename(paths_df: DataFrame, files: DataFrame) -> DataFrame:
    """Raw hit paths to files: the normal path, else the only file of that name, else the raw path."""
    raw = paths_df.withColumn("normal", paths.normalise(F.regexp_replace("raw", "^file://", "")))
    exact = files.select(F.col("path").alias("normal"), F.col("path").alias("exact"))
    named = files.groupBy(paths.name(F.col("path")).alias("base")).agg(F.count("*").alias("n"), F.min("path").alias("only")).where("n = 1").drop("n")
    out = raw.join(exact, "normal", "left").withColumn("base", paths.name(F.col("normal"))).join(named, "base", "left")
    tail = F.col("normal").endswith(F.concat(F.lit("/"), F.col("only")))
    return out.select("hit_id", F.coalesce("exact", F.when(tail | F.col("only").endswith(F.concat(F.lit("/"), F.col("normal"))), F.col("only")), "normal").alias("path"))


def relevant_flows(findings: DataFrame, flows: DataFrame) -> DataFrame:
    """(finding_id, flow_id) of flows that begin or end in a finding's file: two joins, not an OR."""
    ends = [findings.select("finding_id", "file_path").join(flows.select("flow_id", F.col(c).alias("file_path")), "file_path").select("finding_id", "flow_id") for c in ("source_file", "sink_file")]
    return ends[0].union(ends[1]).distinct()


def transitive_only(locked: DataFrame, declared: DataFrame) -> DataFrame:
    """Lockfile entries that no manifest of the same directory declares."""
    keyed = lambda df: df.withColumn("_dir", F.regexp_extract("source_file", "^(.*/)?[^/]*$", 1)).withColumn("_key", packages.normal(F.col("name"), F.col("ecosystem")))
    return keyed(locked).join(keyed(declared).select("_dir", "ecosystem", "_key").distinct(), ["_dir", "ecosystem", "_key"], "left_anti").drop("_dir", "_key")


def distinct_hits(hits: DataFrame) -> DataFrame:
    """Usage hits of a dependency, one for each file, kind and symbol."""
    return hits.dropDuplicates(["id", "file", "kind", "symbol"])


def usage(dependencies: DataFrame, hits: DataFrame) -> DataFrame:
    """Relevance of dependencies (id, is_dev, transitive) from usage hits (id, file, kind)."""
    from ..functions.scores import relevance

    test = paths.in_tests(F.col("file"))
    seen = distinct_hits(hits).groupBy("id").agg(
        F.bool_or(~test & (F.col("kind") == "import")).alias("direct"), F.bool_or(~test & (F.col("kind") == "reference")).alias("referenced"), F.bool_and(test).alias("tested"), F.bool_or(F.col("kind") == "vulnerable_function").alias("function_hit")
    )
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    out = dependencies.join(seen, "id", "left")
    return out.select(*dependencies.columns, relevance(flag("direct"), flag("referenced"), flag("tested"), F.col("is_dev"), flag("transitive")).alias("relevance"), flag("function_hit").alias("function_hit"), flag("direct").alias("imported"))


def title_words(a: str, b: str):
    return text.jaccard(text.tokens(F.col(a)), text.tokens(F.col(b)))


def function_usage(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """(id, file, function, line) of calls (file, function, object, line) that may be of a dependency's
    vulnerable symbols (id, symbol): their tokens, or object and function together, meet by equality.

    What is said is met with the symbols once; every call of it then has the same ids, each once, so the
    product of calls and ids is made last and shuffled nowhere."""
    wanted = symbols.select("id", F.explode(text.symbol_tokens(F.col("symbol"))).alias("token")).distinct()
    low, owner = F.lower("function"), F.lower(F.coalesce("object", F.lit("")))
    said = F.array(low, F.when(owner != "", F.concat_ws(".", owner, low)).otherwise(low))
    spots = calls.withColumn("_said", F.explode(said)).groupBy("file", "function", "line").agg(F.sort_array(F.collect_set("_said")).alias("_said"))
    ids = spots.select("_said").distinct().withColumn("token", F.explode("_said")).join(wanted, "token").select("_said", "id").distinct()
    return products.paired(spots, ids, ["_said"], "id").select("id", "file", "function", "line")
