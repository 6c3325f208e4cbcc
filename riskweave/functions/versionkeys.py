"""Versions as keys whose byte order is the order of versions, and ranges as tests on keys.

A version, and an advisory's ranges, are read once each; whether one is in the other is then a comparison
of keys in Catalyst, however many pairs there are. Two orders are kept: PEP 440's, where both sides
parse, and the loose one of number tuples for all others."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .versions import loose, strict, tidy

_TEST = "struct<op:string,strict:binary,loose:binary,base:binary,pre:boolean,post:boolean,local:boolean,epoch:binary,release:array<binary>,text:string>"
RANGE = f"struct<any:boolean,ruled:boolean,windows:array<struct<kind:string,rule:array<{_TEST}>,plain:array<{_TEST}>>>>"
VERSION = "version string, strict binary, public binary, base binary, pre boolean, post boolean, local boolean, epoch binary, release array<binary>, loose binary, text string"
_fields = "op strict loose base pre post local epoch release text".split()
_ops = ("!=", ">=", "<=", "==", ">", "<", "=")
_spec = re.compile(r"(~=|===|==|!=|<=|>=|<|>)\s*(\S+)$")


def number(n: int) -> bytes:
    """A number, longer ones behind shorter ones."""
    digits = str(n).encode()
    return len(digits).to_bytes(2) + digits


def strict_key(v, public: bool = False) -> bytes:
    """PEP 440's order; public: without the local part."""
    release = list(v.release)
    while release and not release[-1]:
        release.pop()
    key = number(v.epoch) + b"".join(b"\1" + number(x) for x in release) + b"\0"
    if v.pre is not None:
        key += b"\1" + {"a": b"a", "b": b"b", "rc": b"c"}[v.pre[0]] + number(v.pre[1])
    else:
        key += b"\0" if v.post is None and v.dev is not None else b"\2"
    key += b"\0" if v.post is None else b"\1" + number(v.post)
    key += b"\1" if v.dev is None else b"\0" + number(v.dev)
    for part in [] if public or v.local is None else v.local.split("."):
        key += b"\2" + number(int(part)) if part.isdigit() else b"\1" + part.encode() + b"\0"
    return key + b"\0"


def loose_key(version: str) -> bytes:
    return b"".join(b"\1" + number(x) for x in loose(version)) + b"\0"


def base_key(v) -> bytes:
    """The release alone."""
    from packaging.version import Version

    return strict_key(Version(v.base_version))


def keys_of(version: str) -> dict:
    v = strict(version)
    own = {"loose": loose_key(version), "strict": None, "public": None, "base": None, "pre": False, "post": False, "local": False, "epoch": None, "release": None, "text": None}
    if v is None:
        return own
    return own | {"strict": strict_key(v), "public": strict_key(v, True), "base": base_key(v), "pre": v.is_prerelease, "post": v.is_postrelease, "local": v.local is not None, "epoch": number(v.epoch), "release": [number(x) for x in v.release], "text": str(v).lower()}


def _test(op: str, version: str) -> dict:
    own = keys_of(version)
    return {k: own[k] for k in _fields if k != "op"} | {"op": op}


def _plain(window: str, lenient: bool = True) -> list[dict]:
    """The tests of a window by the loose rules; all must hold."""
    numbers, base = [int(x) for x in re.findall(r"\d+", window)], window[1:].strip()
    if window[0] == "~" and not window.startswith("~=") and len(numbers) >= 2:
        return [_test(">=", base), _test("<", f"{numbers[0]}.{numbers[1] + 1}.0")]
    if window[0] == "^" and numbers:
        major, *rest = numbers
        return [_test(">=", base), _test("<", f"{major + 1}.0.0" if major else f"0.{rest[0] + 1}.0" if rest else "1.0.0")]
    out = []
    for part in filter(None, (c.strip() for c in window.split(","))):
        op = next((o for o in _ops if part.startswith(o)), None)
        if op:
            out.append(_test("==" if op == "=" else op, part.lstrip("=") if op[0] == "=" else part[len(op) :]))
        elif "." in part or not lenient:
            out.append(_test("==", part))
    return out


def _rule(window: str) -> tuple[str, list[dict]]:
    """PyPI's own rule for a window: all, equal, set, or none where it does not apply."""
    from packaging.specifiers import InvalidSpecifier, SpecifierSet
    from packaging.version import Version

    if window[:1] in "~^":
        return "none", []
    if window == "*":
        return "all", []
    if window[:1] not in "<>=!":
        return ("none", []) if strict(window) is None else ("equal", [_test("==", window)])
    try:
        specs = list(SpecifierSet(window.replace(" ", "")))
    except InvalidSpecifier:
        return "none", []
    out = []
    for s in specs:
        if s.operator == "===":
            out.append(dict.fromkeys(_fields) | {"op": "p===", "text": s.version.lower()})
            continue
        prefix = s.version.endswith(".*")
        v = Version(s.version.removesuffix(".*"))
        own = keys_of(str(v))
        if s.operator == "~=":
            out.append({k: own[k] for k in _fields if k != "op"} | {"op": "p>="})
            out.append({k: own[k] for k in _fields if k not in ("op", "release")} | {"op": "p=*", "release": own["release"][:-1]})
        else:
            test = {k: own[k] for k in _fields if k != "op"} | {"op": f"p{s.operator}{'*' if prefix else ''}".replace("==", "=")}
            if s.operator == "<":
                # earlier forms of the version itself are not below it
                test["base"] = strict_key(v if v.is_prerelease else Version(f"{v.public}.dev0"))
            out.append(test)
    return "set", out


def range_of(affected: str | None, ecosystem: str | None) -> dict | None:
    if not affected:
        return None
    affected = affected.strip()
    ruled = (ecosystem or "").strip().lower() == "pypi" and affected[:1] not in "~^"
    windows = [w.strip() for w in affected.split("||")]
    parts = []
    for w in windows:
        kind, rule = _rule(w) if ruled and w else ("no", [])
        parts.append({"kind": kind, "rule": rule, "plain": _plain(w) if w else None})
    return {"any": affected == "*", "ruled": ruled, "windows": parts}


def version_keys(versions: DataFrame, column: str = "version") -> DataFrame:
    """The keys of the distinct versions of a table."""

    def run(frames):
        for f in frames:
            rows = [{"version": v} | keys_of(v) for v in f["version"]]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in VERSION.split(", ")])

    return versions.select(F.col(column).alias("version")).where("version <> ''").distinct().mapInPandas(run, VERSION)


def advisory_bounds(advisories: DataFrame) -> DataFrame:
    """(advisory_id, ranges, listed) of advisories (advisory_id, ecosystem, affected_ranges, affected_range,
    affected_versions): their ranges and listed versions as tests."""

    def run(frames):
        for f in frames:
            rows = []
            for i, eco, ranges, one, listed in zip(f["advisory_id"], f["ecosystem"], f["affected_ranges"], f["affected_range"], f["affected_versions"], strict=True):
                made = [range_of(r, eco) for r in (*(ranges if ranges is not None else ()), one)]
                rows.append((i, [r for r in made if r], [_test("==", v.strip()) for v in (listed if listed is not None else ()) if v]))
            yield pd.DataFrame(rows, columns=["advisory_id", "ranges", "listed"])

    kind = advisories.schema["advisory_id"].dataType.simpleString()
    return advisories.select("advisory_id", "ecosystem", "affected_ranges", "affected_range", "affected_versions").mapInPandas(run, f"advisory_id {kind}, ranges array<{RANGE}>, listed array<{_TEST}>")


def _compared(v: Column, t: Column) -> Column:
    """Does a version meet a test, in PEP 440's order where both sides have one?"""
    both = v["strict"].isNotNull() & t["strict"].isNotNull()
    a, b = F.when(both, v["strict"]).otherwise(v["loose"]), F.when(both, t["strict"]).otherwise(t["loose"])
    op = t["op"]
    return F.when(op == "==", a == b).when(op == "!=", a != b).when(op == ">=", a >= b).when(op == "<=", a <= b).when(op == ">", a > b).otherwise(a < b)


def _ruled(v: Column, t: Column) -> Column:
    """PyPI's operators: the local part counts only where it is asked for, and a release's own earlier or
    later forms are neither before nor behind it."""
    op, n = t["op"], F.size(t["release"])
    zero = F.lit(number(0))
    padded = F.slice(F.concat(v["release"], F.array_repeat(zero, n)), F.lit(1), n)
    same_prefix = (v["epoch"] == t["epoch"]) & (padded == t["release"])
    equal = F.when(t["local"], v["strict"] == t["strict"]).otherwise(v["public"] == t["strict"])
    own = v["base"] == t["base"]
    below = (v["strict"] < t["strict"]) & (t["pre"] | (v["strict"] < t["base"]))
    above = (v["strict"] > t["strict"]) & ~(~t["post"] & v["post"] & own) & ~(v["local"] & own)
    return (
        F.when(op == "p===", v["text"] == t["text"]).when(op == "p=", equal).when(op == "p!=", ~equal).when(op == "p=*", same_prefix).when(op == "p!=*", ~same_prefix)
        .when(op == "p>=", v["public"] >= t["strict"]).when(op == "p<=", v["public"] <= t["strict"]).when(op == "p<", below).otherwise(above)
    )


def affected(v: Column, ranges: Column, listed: Column) -> Column:
    """Is a version (a struct of its keys) in one of the ranges, or listed?"""
    plain = lambda w: w["plain"].isNotNull() & F.forall(w["plain"], lambda t: _compared(v, t))
    known = v["strict"].isNotNull()
    rule = lambda w: (
        F.when(w["kind"] == "no", False).when(~known | (w["kind"] == "none"), None).when(w["kind"] == "all", True)
        .when(w["kind"] == "equal", F.forall(w["rule"], lambda t: v["strict"] == t["strict"])).otherwise(F.forall(w["rule"], lambda t: _ruled(v, t)))
    )

    def holds(r):
        windows = r["windows"]
        any_plain = F.exists(windows, plain)
        one = F.coalesce(rule(F.get(windows, F.lit(0))), any_plain)
        by_rule = F.when(F.size(windows) > 1, F.exists(windows, lambda w: F.coalesce(rule(w), F.lit(False)))).otherwise(one)
        return F.when(r["any"], True).when(r["ruled"], by_rule).otherwise(any_plain)

    return F.exists(ranges, lambda r: F.coalesce(holds(r), F.lit(False))) | F.exists(listed, lambda t: _compared(v, t))
