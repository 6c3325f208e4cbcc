"""Version order and affected ranges. Mixed schemes (PEP 440 where it parses, loose tuples where it
does not) have no Catalyst form, so these are Arrow UDFs over distinct (version, range) pairs."""

from __future__ import annotations

import functools
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fixed


@functools.lru_cache(100_000)
def tidy(version: str) -> str:
    """A version with its qualifiers rewritten to PEP 440 ones."""
    v = version.strip().lstrip("=vV").lower()
    for pattern, to in fixed.QUALIFIERS:
        v = re.sub(pattern, to, v)
    return re.sub(r"\.+", ".", v).strip(".- _") if v else ""


@functools.lru_cache(100_000)
def strict(version: str):
    """The version as PEP 440 has it, or None."""
    from packaging.version import InvalidVersion, Version

    try:
        return Version(tidy(version)) if tidy(version) else None
    except InvalidVersion:
        return None


def loose(version: str) -> tuple:
    """Numbers before the first ``-`` or ``+``, and whether nothing follows."""
    v = strict(version)
    if v is not None:
        return (*v.release, 0 if v.is_prerelease else 1)
    base, *rest = re.split(r"[-+]", tidy(version), maxsplit=1)
    return (*map(int, re.findall(r"\d+", base)), 0 if rest else 1)


def compare(a: str, b: str) -> int:
    x, y = strict(a), strict(b)
    if x is None or y is None:
        x, y = loose(a), loose(b)
    return (x > y) - (x < y)


_HOLDS = {"!=": lambda c: c != 0, ">=": lambda c: c >= 0, "<=": lambda c: c <= 0, "==": lambda c: c == 0, ">": lambda c: c > 0, "<": lambda c: c < 0, "=": lambda c: c == 0}


def _bumped(version: str, low: str, high: str) -> bool:
    return compare(version, low) >= 0 and compare(version, high) < 0


def _specified(version: str, window: str) -> bool | None:
    """PyPI's own rule for one window; None where it does not apply."""
    from packaging.specifiers import InvalidSpecifier, SpecifierSet

    have = strict(version)
    if window[:1] in "~^" or have is None:
        return None
    if window == "*":
        return True
    if window[:1] not in "<>=!":
        want = strict(window)
        return None if want is None else have == want
    try:
        return have in SpecifierSet(window.replace(" ", ""))
    except InvalidSpecifier:
        return None


def in_range(version: str | None, affected: str | None, ecosystem: str | None = None, lenient: bool = True) -> bool:
    """Is a version in an affected range: ``*``, windows joined by ``||``, ``~`` and ``^`` bases,
    comma-joined constraints, or one exact version? lenient: a bare constraint without a dot, and a
    ``~`` base of one number, hold for every version."""
    if not version or not affected:
        return False
    affected = affected.strip()
    if affected == "*":
        return True
    windows = [w.strip() for w in affected.split("||")]
    if (ecosystem or "").strip().lower() == "pypi" and affected[:1] not in "~^":
        by_rule = [_specified(version, w) if w else False for w in windows]
        # of several windows one that the rule cannot judge counts as no match
        if len(windows) > 1 or by_rule[0] is not None:
            return any(by_rule)
    return any(_in_window(version, w, lenient) for w in windows if w)


def _in_window(version: str, window: str, lenient: bool) -> bool:
    numbers = [int(x) for x in re.findall(r"\d+", window)]
    base = window[1:].strip()
    if window[0] == "~" and not window.startswith("~=") and len(numbers) >= 2:
        return _bumped(version, base, f"{numbers[0]}.{numbers[1] + 1}.0")
    if window[0] == "^" and numbers:
        major, *rest = numbers
        return _bumped(version, base, f"{major + 1}.0.0" if major else f"0.{rest[0] + 1}.0" if rest else "1.0.0")
    for part in filter(None, (c.strip() for c in window.split(","))):
        op = next((o for o in _HOLDS if part.startswith(o)), None)
        if op:
            if not _HOLDS[op](compare(version, part.lstrip("=") if op[0] == "=" else part[len(op) :])):
                return False
        elif ("." in part or not lenient) and compare(version, part) != 0:
            return False
    return True


def matches(version: str | None, ranges, affected: str | None, versions, ecosystem: str | None = None) -> bool:
    """Does an advisory (ranges, one range, listed versions) affect a version?"""
    if not version:
        return False
    if any(in_range(version, r, ecosystem) for r in (ranges if ranges is not None else ())) or in_range(version, affected, ecosystem):
        return True
    return any(v and compare(version, v.strip()) == 0 for v in (versions if versions is not None else ()))


@F.pandas_udf(T.BooleanType())
def version_in_range(version: pd.Series, affected: pd.Series, ecosystem: pd.Series) -> pd.Series:
    return pd.Series([in_range(*x) for x in zip(version, affected, ecosystem, strict=True)], dtype=bool)


@F.pandas_udf(T.BooleanType())
def version_matches(version: pd.Series, ranges: pd.Series, affected: pd.Series, versions: pd.Series, ecosystem: pd.Series) -> pd.Series:
    return pd.Series([matches(*x) for x in zip(version, ranges, affected, versions, ecosystem, strict=True)], dtype=bool)


@F.pandas_udf(T.IntegerType())
def compare_versions(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([compare(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="int32")


@F.pandas_udf(T.StringType())
def tidied(version: pd.Series) -> pd.Series:
    return pd.Series([tidy(v or "") for v in version], dtype=object)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def parsed(version: pd.Series) -> pd.Series:
    return pd.Series([list(loose(v or "")) for v in version], dtype=object)
