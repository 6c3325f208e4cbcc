"""Manifests and lockfiles as dependencies: (ecosystem, name, version, source_file, is_dev).

Files are rows (path, content). The format follows from the file's name; each parser yields
(name, version, is_dev). Unreadable files have no dependencies. One Arrow pass reads all formats."""

from __future__ import annotations

import ast
import configparser
import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import packages
from . import yamltext

SCHEMA = "ecosystem string, name string, version string, source_file string, is_dev boolean"
Found = Iterator[tuple[str, object, bool]]


def _sections(data: dict, dev: dict[str, bool]) -> Found:
    for section, is_dev in dev.items():
        for name, version in (data.get(section) or {}).items():
            yield name, version, is_dev


def package_json(text: str) -> Found:
    yield from _sections(json.loads(text), {"dependencies": False, "devDependencies": True, "optionalDependencies": False, "peerDependencies": False})


def package_lock(text: str) -> Found:
    data = json.loads(text)
    if isinstance(data.get("packages"), dict):
        for path, info in data["packages"].items():
            if "node_modules/" in path:
                yield info.get("name") or path.rsplit("node_modules/", 1)[1], info.get("version"), bool(info.get("dev"))
        return
    # version 1 nests; a dev parent makes its children dev
    open_ = [(data.get("dependencies") or {}, False)]
    while open_:
        level, inherited = open_.pop()
        for name, info in level.items():
            if isinstance(info, dict):
                dev = inherited or bool(info.get("dev"))
                yield name, info.get("version"), dev
                open_.append((info.get("dependencies") or {}, dev))


def yarn_lock(text: str) -> Found:
    names: list[str] = []
    for line in text.splitlines():
        if line.rstrip().endswith(":") and line[:1] not in (" ", "\t", ""):
            selectors = [s.strip().strip("\"'") for s in line.rstrip()[:-1].split(",")]
            names = [s.rsplit("@", 1)[0] for s in selectors if "@" in s]
        elif line.strip().startswith("version "):
            for name in names:
                yield name, line.strip()[8:].strip().strip("\"'"), False
            names = []


def pnpm_lock(text: str) -> Found:
    for selector in re.findall(r"(?m)^\s{2,}/(.+):[ \t]*$", text):
        if "@" in selector:
            yield (*selector.rsplit("@", 1), False)


_requirement = re.compile(r"([A-Za-z0-9_.-]+)(?:\[[^\]]+\])?\s*(?:===|==|~=|>=|<=|>|<)?\s*([A-Za-z0-9_.+-]+)?")


def requirement(line: str, is_dev: bool = False) -> Found:
    """One pip requirement: the first version there is, whatever the operator."""
    line = line.strip()
    m = _requirement.match(line.split(";", 1)[0].strip()) if line and not line.startswith(("#", "-", ".", "git+")) else None
    if m and m[2]:
        yield m[1], m[2], is_dev


def requirements(text: str) -> Found:
    for line in text.splitlines():
        yield from requirement(line)


def pipfile_lock(text: str) -> Found:
    for name, info, dev in _sections(json.loads(text), {"default": False, "develop": True}):
        yield name, info.get("version", ""), dev


def poetry_lock(text: str) -> Found:
    import tomllib

    for p in tomllib.loads(text).get("package", []):
        yield p.get("name", ""), p.get("version", ""), p.get("category") == "dev" or "dev" in (p.get("groups") or [])


def cargo_lock(text: str) -> Found:
    for name, version in re.findall(r'(?m)^name\s*=\s*"([^"]+)"\s*\nversion\s*=\s*"([^"]+)"', text):
        yield name, version, False


def go_mod(text: str) -> Found:
    for block in re.findall(r"(?ms)^require\s*\((.*?)^\)", text):
        for name, version in re.findall(r"(?m)^\s*([^\s/][^\s]*)\s+(v[^\s]+)", block):
            yield name, version, False


def go_sum(text: str) -> Found:
    for line in text.splitlines():
        parts = line.split()
        if len(parts) >= 2:
            yield parts[0], parts[1].removesuffix("/go.mod"), False


def gemfile_lock(text: str) -> Found:
    inside = False
    for line in text.splitlines():
        if line.strip() == "specs:":
            inside = True
        elif line and not line.startswith(" "):
            inside = False
        elif inside and (m := re.match(r"\s{4,}(\S+) \(([^)\s]+)\)$", line)):
            yield m[1], m[2], False


def _plain(root):
    for e in root.iter():
        if isinstance(e.tag, str):
            e.tag = e.tag.rsplit("}", 1)[-1]
    return root


def pom_xml(text: str) -> Found:
    for d in _plain(ET.fromstring(text)).iter("dependency"):
        group, artifact = (d.findtext("groupId") or "").strip(), (d.findtext("artifactId") or "").strip()
        if group and artifact:
            yield f"{group}:{artifact}", (d.findtext("version") or "").strip(), (d.findtext("scope") or "").strip() == "test"


def build_gradle(text: str) -> Found:
    for config, group, artifact, version in re.findall(r"(\w+)\s*\(?\s*['\"]([^'\":]+):([^'\":]+):([^'\":]+)['\"]", text):
        yield f"{group}:{artifact}", version, "test" in config.lower()


def csproj(text: str) -> Found:
    for r in _plain(ET.fromstring(text)).iter("PackageReference"):
        yield r.get("Include") or r.get("Update") or "", r.get("Version") or r.findtext("Version") or "", False


def packages_config(text: str) -> Found:
    for p in _plain(ET.fromstring(text)).iter("package"):
        yield p.get("id", ""), p.get("version", ""), p.get("developmentDependency", "").lower() == "true"


def composer_lock(text: str) -> Found:
    data = json.loads(text)
    for section, dev in (("packages", False), ("packages-dev", True)):
        for p in data.get(section) or []:
            yield p.get("name", ""), p.get("version", ""), dev


def composer_json(text: str) -> Found:
    for name, version, dev in _sections(json.loads(text), {"require": False, "require-dev": True}):
        if name != "php" and not name.startswith(("ext-", "lib-")):
            yield name, version, dev


def pubspec_lock(text: str) -> Found:
    for name, p in (yamltext.load(text).get("packages") or {}).items():
        if isinstance(p, dict) and p.get("source") not in ("path", "git"):
            about = p.get("description")
            yield (about.get("name") if isinstance(about, dict) else None) or name, str(p.get("version") or ""), "dev" in str(p.get("dependency") or "")


def mix_lock(text: str) -> Found:
    for name, version in re.findall(r"\{:hex,\s*:([A-Za-z0-9_]+),\s*\"([^\"]+)\"", text):
        yield name, version, False


def setup_py(text: str) -> Found:
    def strings(node) -> list[str]:
        return [e.value for e in getattr(node, "elts", []) if isinstance(e, ast.Constant) and isinstance(e.value, str)]

    for call in ast.walk(ast.parse(text)):
        if isinstance(call, ast.Call) and getattr(call.func, "id", getattr(call.func, "attr", "")) == "setup":
            for k in call.keywords:
                if k.arg == "install_requires":
                    for s in strings(k.value):
                        yield from requirement(s)
                elif k.arg == "extras_require" and isinstance(k.value, ast.Dict):
                    for v in k.value.values:
                        for s in strings(v):
                            yield from requirement(s, True)


def setup_cfg(text: str) -> Found:
    c = configparser.ConfigParser()
    c.read_string(text)
    lines = [(x, False) for x in c.get("options", "install_requires", fallback="").splitlines()]
    if c.has_section("options.extras_require"):
        lines += [(x, True) for _, v in c.items("options.extras_require") for x in v.splitlines()]
    for line, dev in lines:
        yield from requirement(line, dev)


#: File name to ecosystem and parser.
FORMATS: dict[str, tuple[str, Callable[[str], Found]]] = {
    "package.json": ("npm", package_json),
    "package-lock.json": ("npm", package_lock),
    "npm-shrinkwrap.json": ("npm", package_lock),
    "yarn.lock": ("npm", yarn_lock),
    "pnpm-lock.yaml": ("npm", pnpm_lock),
    "requirements.txt": ("pypi", requirements),
    "Pipfile.lock": ("pypi", pipfile_lock),
    "poetry.lock": ("pypi", poetry_lock),
    "setup.py": ("pypi", setup_py),
    "setup.cfg": ("pypi", setup_cfg),
    "Cargo.lock": ("crates.io", cargo_lock),
    "go.mod": ("go", go_mod),
    "go.sum": ("go", go_sum),
    "Gemfile.lock": ("rubygems", gemfile_lock),
    "pom.xml": ("maven", pom_xml),
    "build.gradle": ("maven", build_gradle),
    "build.gradle.kts": ("maven", build_gradle),
    "packages.config": ("nuget", packages_config),
    "composer.lock": ("packagist", composer_lock),
    "composer.json": ("packagist", composer_json),
    "pubspec.lock": ("pub", pubspec_lock),
    "mix.lock": ("hex", mix_lock),
}


def parse(path: str, content: str | None) -> list[tuple[str, str, object, bool]]:
    name = path.rsplit("/", 1)[-1]
    ecosystem, parser = ("nuget", csproj) if name.endswith(".csproj") else FORMATS.get(name, (None, None))
    if parser is None or not content:
        return []
    try:
        return [(ecosystem, n, v, d) for n, v, d in parser(content)]
    except (ValueError, TypeError, AttributeError, KeyError, SyntaxError, ImportError, RecursionError, ET.ParseError, configparser.Error):
        return []
    except Exception as e:  # a YAML library's own errors
        if type(e).__module__.startswith("yaml"):
            return []
        raise


def is_manifest(path):
    base = F.element_at(F.split(path, "/"), -1)
    return base.isin(*FORMATS) | base.endswith(".csproj")


def dependencies(files: DataFrame) -> DataFrame:
    """All dependencies of the files; names and versions are never empty."""

    def run(frames):
        for f in frames:
            rows = [(e, n, v, p, d) for p, c in zip(f["path"], f["content"], strict=True) for e, n, v, d in parse(p, c)]
            rows = [(e, str(n or "").strip(), (v.get("version") or v.get("resolved") or "") if isinstance(v, dict) else v if isinstance(v, str) else "", p, d) for e, n, v, p, d in rows]
            yield pd.DataFrame(rows, columns=["ecosystem", "name", "version", "source_file", "is_dev"])

    rows = files.where(is_manifest(F.col("path"))).select("path", "content").mapInPandas(run, SCHEMA)
    return rows.withColumn("version", packages.clean_version(F.col("version"))).where("name <> '' and version <> ''")


def inventory(files: DataFrame) -> DataFrame:
    """Distinct dependencies: of those whose normal names agree, the first in alphabetical order."""
    rows = dependencies(files).withColumn("_key", packages.normal(F.col("name"), F.col("ecosystem")))
    w = Window.partitionBy("ecosystem", "_key", "version", "source_file", "is_dev").orderBy("name")
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_key")


def _json_names(*sections: str):
    return lambda text: [n for s in sections for n in (json.loads(text).get(s) or {})]


def _cargo_names(text: str) -> list[str]:
    import tomllib

    data = tomllib.loads(text)
    tables = [data, *(data.get("target") or {}).values()]
    return [n for t in tables for s in ("dependencies", "dev-dependencies", "build-dependencies") for n in (t.get(s) or {})]


def _pubspec_names(text: str) -> list[str]:
    data = yamltext.load(text) or {}
    return [n for s in ("dependencies", "dev_dependencies") for n in (data.get(s) or {})]


#: Manifests, the ecosystem of each, and the names that it declares.
DECLARING = {
    "package.json": ("npm", _json_names("dependencies", "devDependencies", "optionalDependencies", "peerDependencies")),
    "composer.json": ("packagist", lambda text: [n for n in _json_names("require", "require-dev")(text) if n != "php"]),
    "pubspec.yaml": ("pub", _pubspec_names),
    "Cargo.toml": ("crates.io", _cargo_names),
    "go.mod": ("go", lambda text: re.findall(r"(?m)^\s*(?:require\s+)?(\S+)\s+v\S", text)),
    "Gemfile": ("rubygems", lambda text: re.findall(r"""(?im)gem\s+["']([^"']+)["']""", text)),
    "mix.exs": ("hex", lambda text: re.findall(r"\{\s*:(\w+)\s*,", text)),
}


def declared(files: DataFrame) -> DataFrame:
    """(source_file, ecosystem, name) of what manifests (path, content) declare, whatever the version;
    those that do not parse declare nothing."""

    def run(frames):
        for f in frames:
            rows = []
            for path, content in zip(f["path"], f["content"], strict=True):
                ecosystem, names = DECLARING.get(path.rsplit("/", 1)[-1], (None, None))
                try:
                    rows += [(path, ecosystem, str(n)) for n in names(content or "")] if names else []
                except (ValueError, TypeError, AttributeError, RecursionError):
                    continue
                except Exception as e:  # a YAML library's own errors
                    if not type(e).__module__.startswith("yaml"):
                        raise
            yield pd.DataFrame(rows, columns=["source_file", "ecosystem", "name"])

    base = F.element_at(F.split("path", "/"), -1)
    return files.where(base.isin(*DECLARING)).select("path", "content").mapInPandas(run, "source_file string, ecosystem string, name string")


def declares(asked: DataFrame, files: DataFrame) -> DataFrame:
    """Questions (id, source_file, ecosystem, name) with whether the manifest declares the package under
    any spelling."""
    named = declared(files).select("source_file", "ecosystem", packages.normal(F.col("name"), F.col("ecosystem")).alias("_key")).distinct().withColumn("declared", F.lit(True))
    rows = asked.withColumn("_key", packages.normal(F.col("name"), F.col("ecosystem"))).join(named, ["source_file", "ecosystem", "_key"], "left")
    return rows.withColumn("declared", F.coalesce("declared", F.lit(False))).drop("_key")


def pinned(files: DataFrame) -> DataFrame:
    """(source_file, package, version) of dependencies that name one version of two numbers and more:
    ``==`` in requirements, any operator before it in JSON manifests, all of lockfiles."""
    base, text = F.element_at(F.split("path", "/"), -1), F.col("content")
    entries = lambda *s: F.flatten(F.array_compact(F.array(*[F.map_entries(F.from_json(text, ", ".join(f"`{x}` map<string,string>" for x in s))[x]) for x in s])))
    of_json = F.when(base == "package.json", entries("dependencies", "devDependencies")).when(base == "composer.json", F.filter(entries("require", "require-dev"), lambda e: e["key"] != "php"))
    rows = files.where(base.isin("package.json", "composer.json")).select(F.col("path").alias("source_file"), F.explode(of_json).alias("e")).select("source_file", F.col("e.key").alias("package"), F.trim(F.regexp_replace("e.value", r"^[\^~>=<]+", "")).alias("version")).where(r"version rlike '^[0-9]+[.][0-9]+'")
    line = r"(?m)^[ \t]*([A-Za-z0-9_-]+)\s*==\s*([0-9.]+)"
    found = F.arrays_zip(F.regexp_extract_all(text, F.lit(line), F.lit(1)).alias("n"), F.regexp_extract_all(text, F.lit(line), F.lit(2)).alias("v"))
    listed = files.where(base == "requirements.txt").select(F.col("path").alias("source_file"), F.explode(found).alias("r")).select("source_file", F.lower("r.n").alias("package"), F.col("r.v").alias("version"))
    locked = dependencies(files.where(base.isin("pubspec.lock", "mix.lock"))).select("source_file", F.col("name").alias("package"), "version")
    return rows.unionByName(listed).unionByName(locked).distinct()
