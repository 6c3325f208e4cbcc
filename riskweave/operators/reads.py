"""Reads that pages, tools and chats make: results of scanners, secrets, findings by file or title, and
vulnerable dependencies that a file uses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, packages, paths, patterns
from ..functions.columns import any_of, lookup
from . import products
from .findings import top_per_group


def scanner_results(results: DataFrame, files: DataFrame, scanner: str | None = None, severity: str | None = None, path: str | None = None, limit: int = 200) -> DataFrame:
    """Results with their files' paths, newest first; those without a file stay, unless a path is asked
    for."""
    rows = results.join(files.select("file_id", F.col("path").alias("file_path")), "file_id", "left")
    for name, value in (("scanner", scanner), ("severity", severity), ("file_path", path)):
        rows = rows if value is None else rows.where(F.col(name) == value)
    return rows.orderBy(F.desc("created_at"), F.desc("result_id")).limit(limit)


def hits_of_file(results: DataFrame, files: DataFrame, path: str, limit: int = 50) -> DataFrame:
    """The newest results of one file, with blanks for what is unknown."""
    rows = results.join(files.where(F.col("path") == path).select("file_id"), "file_id", "left_semi")
    rows = rows.orderBy(F.desc("created_at"), F.desc("result_id")).limit(limit)
    return rows.withColumns({"rule_id": F.coalesce("rule_id", F.lit("")), "severity": F.coalesce("severity", F.lit("info")), "message": F.coalesce("message", F.lit("")), "start_line": F.coalesce("start_line", F.lit(0))})


def secrets_of_scan(candidates: DataFrame, files: DataFrame) -> DataFrame:
    """Secret candidates with the paths of their files, where they have one."""
    return candidates.join(files.select("file_id", F.col("path").alias("file_path")), "file_id", "left").drop("file_id")


def with_paths(findings: DataFrame, links: DataFrame, files: DataFrame) -> DataFrame:
    """Findings with the sorted paths of the files that are linked to them."""
    paths = links.join(files.select("file_id", "path"), "file_id").groupBy("finding_id").agg(F.sort_array(F.collect_set("path")).alias("file_paths"))
    return findings.join(paths, "finding_id", "left").withColumn("file_paths", F.coalesce("file_paths", F.array().cast("array<string>")))


def findings_of_file(findings: DataFrame, links: DataFrame, files: DataFrame, path: str) -> DataFrame:
    """Findings that are linked to a file, whose path may be given in part, or that speak of it: of its
    path in description or snippet, or of its name in title or description."""
    wanted = path.lower().replace("\\", "/")
    name, known = wanted.split("/")[-1], F.lower(F.replace(F.col("path"), F.lit("\\"), F.lit("/")))
    same = (known == wanted) | known.endswith(wanted) | F.lit(wanted).endswith(known)
    linked = links.join(files.where(same).select("file_id"), "file_id", "left_semi").select("finding_id").distinct().withColumn("_linked", F.lit(True))
    says = lambda c, what: F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(what))
    spoken = says("description", wanted) | says("code_snippet", wanted) | says("title", name) | says("description", name)
    return findings.join(linked, "finding_id", "left").where(F.col("_linked").isNotNull() | spoken).drop("_linked")


def by_title(findings: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, finding_id): the first finding, by id, whose title holds the query, whatever the case.
    Titles repeat, so the distinct ones are searched, and queries are few (they are broadcast by the
    plan where their size allows)."""
    titles = findings.groupBy(F.lower("title").alias("_title")).agg(F.min("finding_id").alias("finding_id"))
    return titles.join(queries, F.contains(F.col("_title"), F.lower("query"))).groupBy("query").agg(F.min("finding_id").alias("finding_id"))


def dependency_findings(found: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Findings of dependencies with the dependency, highest risk first, unknown risk last."""
    return found.join(dependencies, "dependency_id").orderBy(F.desc_nulls_last("risk_score"), "finding_id")


def dependency_cache(found: DataFrame, dependencies: DataFrame) -> DataFrame:
    """What an investigation keeps of vulnerable dependencies: short details, two references, and the
    package's key."""
    blank = lambda c, to="": F.coalesce(c, F.lit(to)).alias(c)
    rows = found.join(dependencies.select("dependency_id", "name", "version", "ecosystem"), "dependency_id")
    return rows.select(
        F.replace(F.lower("name"), F.lit("-"), F.lit("_")).alias("key"),
        F.col("name").alias("package"),
        "version",
        "ecosystem",
        blank("advisory_id"),
        blank("cve_id"),
        blank("severity", "medium"),
        F.substring(F.coalesce("details", F.lit("")), 1, 300).alias("details"),
        F.slice(F.coalesce("references", F.array().cast("array<string>")), 1, 2).alias("references"),
        "risk_score",
    )


#: What may stand before a package's name where a text imports it.
IMPORT_WORDS = ["import ", "from ", "require('", 'require("', "import '", 'import "', "use ", "alias "]
#: The longest name that is looked for after such a word.
LONGEST = 80


def dependencies_of_files(dependencies: DataFrame, imports: DataFrame, files: DataFrame, limit: int = 5, head: int | None = None) -> DataFrame:
    """Vulnerable dependencies (id, package, ecosystem, risk_score) that files use, best first.

    External imports (file, import_module, is_external) decide where any of a file's means one of the
    packages. In other files the text decides: a name after an import's word. Aliases meet imports and
    texts by equality; a text's names are all prefixes of what follows its words. head: look at so many
    first characters only."""
    names = dependencies.select("package", "ecosystem").distinct()
    alias = names.select("package", "ecosystem", F.explode(packages.import_aliases(F.col("package"), F.col("ecosystem"))).alias("alias"))
    outside = imports.where("is_external").select("file", "import_module").distinct()
    pairs = outside.withColumn("alias", F.explode(packages.import_candidates(F.col("import_module")))).join(alias, "alias").select("file", "import_module", "package", "ecosystem").distinct()
    sure = pairs.withColumn("m", packages.import_match(F.col("package"), F.col("ecosystem"), F.col("import_module"))).where("m is not null")
    sure = sure.groupBy("file", "package", "ecosystem").agg(F.max(F.struct(F.col("m.confidence").alias("confidence"), F.col("m.kind").alias("kind"))).alias("m"), F.max_by("import_module", F.struct(F.col("m.confidence"), F.col("import_module"))).alias("import_module"))
    sure = sure.select("file", "package", "ecosystem", "m.confidence", "m.kind", "import_module", F.lit("import_graph").alias("source"))
    low = F.lower("package")
    spelt = names.select("package", "ecosystem", F.explode(F.array(low, F.replace(low, F.lit("-"), F.lit("_")), F.replace(low, F.lit("_"), F.lit("-")))).alias("alias"))
    variants = alias.unionByName(spelt).where("alias <> ''").distinct()
    text = F.lower("content") if head is None else F.lower(F.substring("content", 1, head))
    rest = files.select(F.col("path").alias("file"), text.alias("content")).join(sure.select("file").distinct(), "file", "left_anti")
    parts = lambda w: F.split("content", f"\\Q{w}\\E", -1)
    after = F.flatten(F.array(*[F.transform(F.slice(parts(w), F.lit(2), F.size(parts(w)) - 1), lambda x: F.substring(x, 1, LONGEST)) for w in IMPORT_WORDS]))
    told = rest.select("file", F.explode(F.array_distinct(after)).alias("said")).where("said <> ''")
    # what is said is met once, however many files say it
    begins = told.select("said").distinct().select("said", F.explode(F.transform(F.sequence(F.lit(1), F.length("said")), lambda i: F.substring("said", F.lit(1), i))).alias("alias"))
    guessed = told.join(begins.join(variants, "alias"), "said").groupBy("file", "package", "ecosystem").agg(F.min("alias").alias("import_module"))
    guessed = guessed.select("file", "package", "ecosystem", F.lit(0.55).alias("confidence"), F.lit("import").alias("kind"), "import_module", F.lit("text_fallback").alias("source"))
    # of one package a file can have the first dependencies only, which are the same for all files
    few = top_per_group(dependencies, ["package", "ecosystem"], [F.desc_nulls_last("risk_score"), F.col("id")], limit)
    rows = sure.unionByName(guessed).join(few, ["package", "ecosystem"])
    return top_per_group(rows, ["file"], [F.desc_nulls_last("risk_score"), F.desc("confidence"), F.col("package"), F.col("id")], limit)


def best_dependency(advisories: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Of each advisory (advisory_id, package, ecosystem) the vulnerable dependency (id, package,
    ecosystem, source) that may mean its package: one that the import graph found is strong, any other
    medium. Names meet by their keys."""
    keys = lambda df, *c: df.select(*c, F.lower(F.trim("ecosystem")).alias("eco"), F.explode(packages.index_keys(F.col("package"), F.col("ecosystem"))).alias("key"))
    rank = F.when(F.col("source") == "import_graph", 2).otherwise(1)
    # the best of a key is the best for every advisory under it
    first = keys(dependencies, "id", "source").groupBy("eco", "key").agg(F.max(F.struct(rank.alias("rank"), (-F.col("id")).alias("id"))).alias("b"))
    best = keys(advisories, "advisory_id").join(first, ["eco", "key"]).groupBy("advisory_id").agg(F.max("b").alias("b"))
    return best.select("advisory_id", (-F.col("b.id")).alias("id"), F.when(F.col("b.rank") >= 2, "strong").otherwise("medium").alias("strength"))


def import_hints(symbols: Column, paths: Column, function: Column) -> Column:
    """Modules by which an advisory's function may be imported: those of the symbols of that name, else
    all that the advisory names. symbols: array of (symbol, import_path)."""
    clean = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    given = F.filter(F.coalesce(symbols, F.array().cast("array<struct<symbol:string,import_path:string>>")), lambda s: clean(s["import_path"]) != "")
    word = clean(function)
    aimed = F.filter(given, lambda s: (word != "") & F.array_contains(packages.function_keys(F.coalesce(s["symbol"], F.lit(""))), word))
    modules = lambda a: F.transform(a, lambda s: clean(s["import_path"]))
    others = F.filter(F.transform(F.coalesce(paths, F.array().cast("array<string>")), clean), lambda p: p != "")
    return F.array_sort(F.array_distinct(F.when(F.size(aimed) > 0, modules(aimed)).otherwise(F.concat(modules(given), others))))


def hint_confidence(module: Column, hint: Column) -> Column:
    """How surely an imported module is, holds, or lies in a hinted one."""
    a, b = (F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in (module, hint))
    under = lambda x, y: x.startswith(F.concat(y, F.lit("."))) | x.startswith(F.concat(y, F.lit("/")))
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).when(under(a, b), 0.99).when(under(b, a), 0.97).otherwise(0.0)


def best_import(advisories: DataFrame, imports: DataFrame) -> DataFrame:
    """(advisory_id, import_module, confidence): of each advisory (package, ecosystem, hints) the
    external import that most likely is its package, by hint or by name."""
    outside = imports.where("is_external").select("import_module").distinct()
    heads = outside.select("import_module", F.explode(packages.import_candidates(F.col("import_module"))).alias("k"))
    named = advisories.select("advisory_id", "package", "ecosystem", F.explode(packages.import_aliases(F.col("package"), F.col("ecosystem"))).alias("k")).join(heads, "k")
    named = named.select("advisory_id", "package", "ecosystem", "import_module").distinct().withColumn("m", packages.import_match(F.col("package"), F.col("ecosystem"), F.col("import_module"))).where("m is not null")
    named = named.select("advisory_id", "import_module", F.col("m.confidence").alias("confidence"))
    # a hint and a module meet where one is the other's prefix at a dot or slash
    cut = lambda c: packages.import_candidates(c)
    hints = advisories.select("advisory_id", F.explode("hints").alias("hint"))
    over = hints.withColumn("k", F.col("hint")).join(heads, "k").select("advisory_id", "hint", "import_module")
    under = hints.withColumn("k", F.explode(cut(F.col("hint")))).join(outside.withColumn("k", packages.clean(F.col("import_module"))), "k").select("advisory_id", "hint", "import_module")
    hinted = over.unionByName(under).distinct().select("advisory_id", "import_module", hint_confidence(F.col("import_module"), F.col("hint")).alias("confidence")).where("confidence > 0")
    rows = named.unionByName(hinted)
    return top_per_group(rows, ["advisory_id"], [F.desc("confidence"), F.col("import_module")], 1)


def external_imports(imports: DataFrame) -> DataFrame:
    """External imports that name a module, with their names trimmed and blanks left out."""
    names = F.filter(F.transform(F.coalesce("imported_names", F.array().cast("array<string>")), lambda n: F.trim(n)), lambda n: n != "")
    rows = imports.where(F.col("is_external") & (F.coalesce("import_module", F.lit("")) != ""))
    return rows.withColumns({"imported_names": names, "line": F.coalesce("line", F.lit(0))})


def entry_points_of_findings(findings: DataFrame, entries: DataFrame) -> DataFrame:
    """(finding_id, entry_id) of entry points in a finding's file, or under its directory (by the
    beginning of their paths), or whose function its snippet or hypothesis names.

    Directories are exploded into the beginnings of the entries' paths, functions into the words of the
    findings' texts, so both are joins by equality. A function is named as a whole word. Findings of the same
    directories have the same entry points, so those are found once, and the product is made last."""
    home = F.when(F.contains("file_path", F.lit("/")), F.regexp_extract("file_path", "^(.*)/[^/]*$", 1)).otherwise(F.col("file_path"))
    near = findings.select("finding_id", home.alias("_at")).where("_at <> ''").groupBy("finding_id").agg(F.sort_array(F.collect_set("_at")).alias("_homes"))
    homes = near.select("_homes").distinct().withColumn("_at", F.explode("_homes"))
    begins = F.transform(F.sequence(F.lit(1), F.length("file")), lambda i: F.substring("file", F.lit(1), i))
    files = entries.select("file").where("file <> ''").distinct().select("file", F.explode(begins).alias("_at")).join(homes, "_at").select("file", "_homes").distinct()
    members = files.join(entries.where("file <> ''").select("entry_id", "file"), "file").select("_homes", "entry_id").distinct()
    by_file = products.paired(near, members, ["_homes"], "entry_id").select("finding_id", "entry_id")
    words = F.array_distinct(F.regexp_extract_all(F.concat_ws(" ", F.coalesce("code_snippet", F.lit("")), F.coalesce("hypothesis", F.lit(""))), F.lit(r"(\w+)"), F.lit(1)))
    named = findings.select("finding_id", F.explode(words).alias("function")).join(entries.where("function <> ''").select("entry_id", "function"), "function").select("finding_id", "entry_id").distinct()
    # those that only a text names
    far = named.join(near.withColumnRenamed("finding_id", "_f"), F.col("finding_id").eqNullSafe(F.col("_f")), "left").join(members, ["_homes", "entry_id"], "left_anti").select("finding_id", "entry_id")
    return by_file.unionByName(far)


def strong_signals(has_exploit: Column, related: Column, verified_flow: Column, confidence: Column) -> Column:
    """How many of four strong signals a finding has. related: array of (evidence_strength,
    evidence_type) of its advisories."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    told = F.exists(related, lambda r: low(r["evidence_strength"]).isin("strong", "medium") | low(r["evidence_type"]).contains("confirmed"))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return flag(has_exploit) + flag(told) + flag(verified_flow) + flag(confidence >= 0.9)


def finalised(findings: DataFrame) -> DataFrame:
    """The last rules of verification, from the number of strong ``signals``: a confirmed finding is
    statically verified at least, and strongly with two signals; without a signal and with little
    confidence a severe one is lowered by a step."""
    rank = lookup(F.col("verification_level"), fixed.VERIFICATION_RANK, 0)
    level = F.when(F.col("signals") >= 2, "strongly_verified").when(rank < fixed.VERIFICATION_RANK["statically_verified"], "statically_verified").otherwise(F.col("verification_level"))
    weak = (F.col("signals") == 0) & (F.col("confidence") < 0.65)
    low = F.lower("severity")
    return findings.withColumns({"verification_level": level, "severity": F.when(weak & (low == "critical"), "high").when(weak & (low == "high"), "medium").otherwise(F.col("severity"))})


def dismissed(findings: DataFrame, reason: Column, which: Column) -> DataFrame:
    """Findings, those that are dismissed with the reason as a note and as opposing evidence."""
    notes = F.concat_ws("\n\n", F.nullif(F.coalesce("verification_notes", F.lit("")), F.lit("")), reason)
    change = {"status": F.lit("dismissed"), "verification_level": F.lit("dismissed"), "severity": F.lit("info"), "confidence": F.least("confidence", F.lit(0.1)), "verification_notes": notes, "opposing_evidence": F.array_distinct(F.array_append("opposing_evidence", reason))}
    return findings.withColumns({c: F.when(which, v).otherwise(F.col(c)) for c, v in change.items()})


def needs_flow(title: Column, category: Column, text: Column) -> Column:
    """Does a finding claim a flow of data, so that it needs a context?"""
    return patterns.mentions(F.concat_ws(" ", title, category, text), patterns.DATA_FLOW_TERMS)


def gap_reason(severity: Column, needs_context: Column, context: Column, path: Column) -> Column:
    """Why a severe finding that claims a flow lacks evidence; null where it does not."""
    gap = severity.isin("critical", "high") & needs_context & ~context
    return F.when(gap & paths.low_context(path), "low context").when(gap, "no flow")


def merged_by_keys(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row, in order, of each combination of keys, compared without case and blanks."""
    plain = [F.lower(F.trim(F.coalesce(F.col(k).cast("string"), F.lit("")))).alias(f"_{k}") for k in keys]
    w = Window.partitionBy(*[f"_{k}" for k in keys]).orderBy(*order)
    out = rows.select("*", *plain).withColumn("_n", F.row_number().over(w)).where("_n = 1")
    return out.drop("_n", *[f"_{k}" for k in keys])


#: Names of scanners as settings write them, and what runs where nothing is set.
SCANNER_NAMES = {"semgrep": "semgrep", "bandit": "bandit", "eslint": "eslint", "codeql": "codeql", "secrets": "secrets", "dependencies": "dep_audit", "dependency": "dep_audit", "dep_audit": "dep_audit"}
DEFAULT_SCANNERS = {"semgrep": True, "bandit": True, "eslint": True, "codeql": True, "secrets": True, "dep_audit": True}


def scanner_config(raw: Column) -> Column:
    """Settings of scanners as a map of all of them: known names in any spelling replace the defaults;
    of two spellings of one scanner the last in the map counts."""
    known = lambda k: lookup(F.lower(F.trim(k)), SCANNER_NAMES)
    given = F.filter(F.map_entries(F.coalesce(raw, F.create_map().cast("map<string,boolean>"))), lambda e: known(e["key"]).isNotNull())
    value = lambda name: F.try_element_at(F.filter(given, lambda e: known(e["key"]) == name), F.lit(-1))["value"]
    return F.create_map(*[x for n, on in DEFAULT_SCANNERS.items() for x in (F.lit(n), F.coalesce(value(n), F.lit(on)))])


def any_text(*columns: str) -> Column:
    return any_of([F.coalesce(F.col(c), F.lit("")) != "" for c in columns])
