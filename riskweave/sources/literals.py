"""Many expressions over a text at once: the literals that each needs, found in one scan."""

from __future__ import annotations

import functools
import re
from bisect import bisect_right
from dataclasses import dataclass, field
from re import _constants as C
from re import _parser

#: Shorter literals tell too little.
LEAST = 2
#: Letters that match an ASCII letter when case does not count, though their lower case is another.
LIKE = str.maketrans({"ſ": "s", "ı": "i", "İ": "i", "\u212a": "k"})


def folded(text: str) -> str:
    """The text in lower case, letters at their places."""
    return text.translate(LIKE).lower()


def _best(options: list[list[str]]) -> list[str] | None:
    """Of sets of literals, one of which must occur, the one whose shortest is longest."""
    return max((x for x in options if x), key=lambda x: (min(map(len, x)), -len(x)), default=None)


def _flat(items):
    """Groups that stand once are what is in them, so that literals go on across their ends."""
    for op, value in items:
        if op in (C.SUBPATTERN, C.ATOMIC_GROUP):
            yield from _flat(value[-1] if op is C.SUBPATTERN else value)
        else:
            yield op, value


def _needed(items) -> list[list[str]]:
    """Sets of literals of which a match has one each."""
    out, run = [], ""
    for op, value in [*_flat(items), (None, None)]:
        if op is C.LITERAL and value < 128:
            run += chr(value).lower()
            continue
        if run:
            out.append([run])
            run = ""
        if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and value[0] > 0:
            out += _needed(value[2])
        elif op is C.BRANCH:
            each = [_best(_needed(b)) for b in value[1]]
            if all(each):
                out.append([x for some in each for x in some])
    return out


def literals(pattern: str) -> list[str] | None:
    """Literals in lower case of which every match of an expression has one; None if none is known."""
    try:
        found = _best(_needed(_parser.parse(pattern)))
    except (re.error, RecursionError, OverflowError):
        return None
    return found if found and min(map(len, found)) >= LEAST else None


def glob(pattern: str) -> re.Pattern:
    """A path pattern: of a name or directory anywhere, or from the root if it begins with a slash; what lies
    in a directory belongs to it."""
    root, body = pattern.startswith("/"), pattern.strip("/")
    parts = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    made = "".join(parts.get(x) or re.escape(x) for x in re.split(r"(\*\*/|\*\*|\*|\?)", body))
    return re.compile(f"{'^' if root else '(?:^|/)'}{made}(?:/.*)?$", re.DOTALL)


@dataclass
class Rule:
    id: str
    severity: str | None
    regexes: list[str]
    not_regexes: list[str] = field(default_factory=list)
    metavariables: list[tuple[str, str]] = field(default_factory=list)
    languages: set[str] = field(default_factory=set)
    includes: list[str] = field(default_factory=list)
    excludes: list[str] = field(default_factory=list)


class Tried:
    """A rule whose expressions are compiled when it is first tried. A rule with an expression that is none
    matches nothing."""

    def __init__(self, rule: Rule):
        self.rule = rule
        self.includes, self.excludes = ([glob(p) for p in ps] for ps in (rule.includes, rule.excludes))

    @functools.cached_property
    def compiled(self):
        import regex

        try:
            one, none = ([regex.compile(p) for p in ps] for ps in (self.rule.regexes, self.rule.not_regexes))
            return one, none, [(int(n) if n.isdigit() else n, regex.compile(p)) for n, p in self.rule.metavariables]
        except regex.error:
            return [], [], []

    def reads(self, path: str, language: str | None) -> bool:
        from .rules import ANY_LANGUAGE

        known = self.rule.languages
        if language and known and language not in known and not known & ANY_LANGUAGE:
            return False
        return (not self.includes or any(p.search(path) for p in self.includes)) and not any(p.search(path) for p in self.excludes)

    def matches(self, line: str) -> bool:
        """Is there a match whose groups are as they must be, and that overlaps none that must not be?"""
        any_of, none, groups = self.compiled
        barred = [m.span() for p in none for m in p.finditer(line)]
        for p in any_of:
            for m in p.finditer(line):
                if any(a < m.end() and m.start() < b or (a, b) == m.span() for a, b in barred):
                    continue
                if all(self._held(m, n, g) for n, g in groups):
                    return True
        return False

    @staticmethod
    def _held(m, name, expression) -> bool:
        try:
            value = m.group(name)
        except (IndexError, KeyError):
            return False
        return value is not None and expression.match(value) is not None


class Scanner:
    """Rules behind an automaton of their literals."""

    def __init__(self, rules: list[Rule]):
        import ahocorasick

        self.tried = [Tried(r) for r in rules]
        self.always, of = [], {}
        for i, t in enumerate(self.tried):
            each = [literals(p) for p in t.rule.regexes]
            if all(each):
                for x in {x for some in each for x in some}:
                    of.setdefault(x, []).append(i)
            else:
                self.always.append(i)
        self.automaton = ahocorasick.Automaton() if of else None
        for x, rules_ in of.items():
            self.automaton.add_word(x, rules_)
        if of:
            self.automaton.make_automaton()

    def hits(self, path: str, text: str, language: str | None = None):
        """(line, id, severity) of the lines that rules match."""
        lines = text.split("\n")
        starts, at = [], 0
        for line in lines:
            starts.append(at)
            at += len(line) + 1
        maybe = {(i, k) for i in self.always for k in range(len(lines))}
        if self.automaton:
            for end, rules in self.automaton.iter(folded(text)):
                k = bisect_right(starts, end) - 1
                maybe.update((i, k) for i in rules)
        reads: dict[int, bool] = {}
        for i, k in sorted(maybe, key=lambda x: (x[1], x[0])):
            tried = self.tried[i]
            if i not in reads:
                reads[i] = tried.reads(path, language)
            if reads[i] and tried.matches(lines[k]):
                yield k + 1, tried.rule.id, tried.rule.severity


#: Lengths of the ends of literals that texts are searched for.
ENDS = (2, 3, 4, 6, 8, 12, 16, 24)
#: Code points of texts that are searched at once.
STRETCH = 1 << 20
_BASE, _MIX, _WORD = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, (1 << 64) - 1


def end_of(literal: str) -> tuple[int, int, int]:
    """The hash of a literal's end, how long that end is, and its last two characters as a number."""
    size = max(n for n in ENDS if n <= len(literal))
    value = size
    for b in literal[-size:].encode():
        value = (value * _BASE + b) & _WORD
    return value - (1 << 64) if value >> 63 else value, size, ord(literal[-2]) << 8 | ord(literal[-1])


def bits_of(ends, size: int):
    """The two bits of a filter of so many (a power of two) that stand for each hash."""
    h = ends.view("uint64")
    h = (h ^ (h >> 31)) * _MIX
    h ^= h >> 29
    return h & (size - 1), (h >> 33) & (size - 1)


class Ends:
    """A filter of the ends of literals of any number: pairs of last characters by length, then bits for
    hashes. It may take a place for an end that is none, never the other way round."""

    def __init__(self, pairs: list[tuple[int, int]], bits: bytes):
        import numpy as np

        self.bits, self.pairs = np.frombuffer(bits, "uint8"), {}
        for size, pair in pairs:
            self.pairs.setdefault(size, np.zeros(1 << 16, bool))[pair] = True

    def found(self, buffer):
        """(first place, hash) of the ends in an array of bytes, as arrays for each length."""
        import numpy as np

        pair = buffer[:-1].astype("uint16") << 8 | buffer[1:]
        for size, table in self.pairs.items():
            at = np.flatnonzero(table[pair[size - 2 :]])
            value = np.full(len(at), size, "uint64")
            for j in range(size):
                value = value * _BASE + buffer[at + j]
            held = np.ones(len(at), bool)
            for bit in bits_of(value, len(self.bits) * 8):
                held &= self.bits[bit >> 3] >> (bit & 7).astype("uint8") & 1 == 1
            yield at[held], value[held].view("int64")

    def lines(self, texts: list[str]):
        """(index of the text, line from 1, its text, hash) of the lines in which ends may stand, each once."""
        import numpy as np

        whole = "\n".join(texts)
        buffer = np.frombuffer(folded(whole).encode("ascii", "replace"), "uint8")
        breaks = np.flatnonzero(buffer == 10)
        sizes = np.fromiter(map(len, texts), "int64", len(texts))
        first = np.cumsum(sizes + 1) - sizes - 1
        seen = []
        for begin in range(0, len(buffer), STRETCH):
            for at, value in self.found(buffer[begin : begin + STRETCH + max(ENDS) - 1]):
                seen.append(np.stack([np.searchsorted(breaks, at + begin), value]))
        if not seen:
            return
        for k, value in np.unique(np.concatenate(seen, axis=1), axis=1).T.tolist():
            a, b = int(breaks[k - 1]) + 1 if k else 0, int(breaks[k]) if k < len(breaks) else len(whole)
            i = int(np.searchsorted(first, a, "right")) - 1
            yield i, k - int(np.searchsorted(breaks, first[i])) + 1, whole[a:b], value


_scanners: dict[str, Scanner] = {}


def scanner(key: str, rules) -> Scanner:
    """A worker's scanner of a block, which its tasks share; rules() gives the block."""
    if key not in _scanners:
        _scanners.clear()
        _scanners[key] = Scanner(rules())
    return _scanners[key]
