"""Rules behind the automaton against every rule on every line."""

import random

import pytest
import regex

from riskweave.sources import literals as L
from riskweave.sources import rules as R


def brute(files, rules):
    tried = [(r, *[[regex.compile(p) for p in ps] for ps in (r.regexes, r.not_regexes, [e for _, e in r.metavariables])]) for r in rules]
    for path, text, language in files:
        for r, any_of, none, groups in tried:
            if language and r.languages and language not in r.languages and "regex" not in r.languages:
                continue
            if any(L.glob(g).search(path) for g in r.excludes) or r.includes and not any(L.glob(g).search(path) for g in r.includes):
                continue
            for k, line in enumerate(text.split("\n"), 1):
                bad = [m.span() for p in none for m in p.finditer(line)]
                for m in [m for p in any_of for m in p.finditer(line)]:
                    free = not any(a < m.end() and m.start() < b for a, b in bad)
                    if free and all(m.group(n) is not None and e.match(m.group(n)) for (n, _), e in zip(r.metavariables, groups)):
                        yield path, k, r.id, r.severity
                        break


def many(n):
    r = random.Random(1)
    for i in range(n):
        w = f"tok{r.randrange(4000)}"
        shape = r.choice([r"{0}\b", r"(?i){0}", r"\b(?:{0}|alt{0})\s*=\s*(?<v>\w+)", r"{0}[a-z]{{2,}}", r"(?:x{0})+y?", r"({0})?zz{1}", r"^\s*{0}", r"[{0}]{{5}}q", r"{0}.*{1}", r"(?i:Key)_{0}"])
        groups = [("v", r"[a-f]")] if "<v>" in shape else []
        yield L.Rule(f"r{i}", r.choice(["ERROR", None]), [shape.format(w, i % 97)] + ([f"also{i}"] if r.random() < 0.2 and not groups else []), [r"#\s*ok.*"] if r.random() < 0.3 else [], groups, {r.choice(["python", "go", "regex"])} if r.random() < 0.3 else set(), ["src/**"] if r.random() < 0.1 else [], ["*_test.py"] if r.random() < 0.2 else [])


def texts(n):
    r = random.Random(2)
    word = lambda: r.choice([f"tok{r.randrange(4000)}", f"TOK{r.randrange(4000)}", f"alttok{r.randrange(4000)} = abc", f"xtok{r.randrange(4000)}y", f"zz{r.randrange(97)}", f"KEY_tok{r.randrange(4000)}", f"also{r.randrange(5000)}", "# ok then", "é", "12345q", f"tok{r.randrange(4000)}abc"])
    return [(f"{r.choice(['src', 'lib'])}/f{i}{r.choice(['', '_test'])}.py", "\n".join(" ".join(word() for _ in range(r.randint(0, 6))) for _ in range(r.randint(1, 25))), r.choice(["python", "go", None])) for i in range(n)]


def frame(spark, rules):
    rows = [("p", r.id, sorted(r.languages), r.severity, None, r.regexes[0], r.regexes, r.not_regexes, r.metavariables, r.includes, r.excludes) for r in rules]
    return spark.createDataFrame(rows, R.RULE)


def test_five_thousand_rules_in_blocks(spark, monkeypatch):
    rules, files = list(many(5000)), texts(60)
    want = sorted(brute(files, rules), key=str)
    monkeypatch.setattr(R, "BLOCK", 2000)
    df = spark.createDataFrame([*files, ("none", None, None)], "path string, content string, language string")
    got = sorted((tuple(x) for x in R.matches(df, frame(spark, rules)).collect()), key=str)
    assert got == want and len(want) > 500


def test_broken_rules_match_nothing(spark):
    rules = [L.Rule("bad", "E", ["a("]), L.Rule("worse", "E", ["ok"], ["("]), L.Rule("good", "E", ["ok"]), L.Rule("no group", "E", ["(ok)"], metavariables=[("zz", "x")])]
    df = spark.createDataFrame([("a", "ok\n\nok")], "path string, content string")
    assert [(x.rule_id, x.line) for x in R.matches(df, frame(spark, rules)).collect()] == [("good", 1), ("good", 3)]
    assert R.matches(df, frame(spark, rules).limit(0)).count() == 0


@pytest.mark.parametrize("pattern, want", [("abc", ["abc"]), ("(?i)ABC", ["abc"]), ("a?bcd*", ["bc"]), ("(?:abc|d)x", None), ("[ab]c", None), ("(abc)+d", ["abc"]), ("a(?=bc)de", ["de"]), ("éab", ["ab"]), ("x{0}yz", ["yz"]), ("a(", None), ("(?>ab)c", ["abc"]), ("a(b(?P<n>c)[d])e", ["abcde"]), ("(?:abc|def)x", ["abc", "def"])])
def test_literals(pattern, want):
    assert L.literals(pattern) == want


@pytest.mark.parametrize("letter", "skiKIS")
def test_letters_that_match_in_any_case(letter):
    for c in map(chr, range(0x2200)):
        if regex.match(f"(?i){letter}", c) and letter.lower() != L.folded(c):
            raise AssertionError((letter, c))


def test_globs():
    hit = lambda p, *paths: [x for x in paths if L.glob(p).search(x)]
    assert hit("*_test.go", "a_test.go", "x/b_test.go", "a_test.go.x") == ["a_test.go", "x/b_test.go"]
    assert hit("project/tests", "project/tests/a/b.py", "x/project/tests", "project/testsuite") == ["project/tests/a/b.py", "x/project/tests"]
    assert hit("/src/**/*.js", "src/a.js", "src/a/b.js", "x/src/a.js") == ["src/a.js", "src/a/b.js"]


def test_rules_of_several_expressions(spark):
    text = """
rules:
- id: both
  languages: [regex]
  severity: ERROR
  paths: {include: ["*.py"], exclude: ["vendor"]}
  patterns:
  - pattern-regex: 'key_(?P<V>[a-z]+)'
  - pattern-not-regex: key_none
  - metavariable-regex: {metavariable: $V, regex: '[n-z]'}
- id: one of
  languages: [python]
  pattern-either: [{pattern-regex: foo}, {pattern-regex: bar}]
- id: more
  patterns: [{pattern-regex: foo}, {pattern-inside: bar(...)}]
- id: odd
  patterns: [3]
"""
    rules = R.read(spark.createDataFrame([("a.yaml", text)], "path string, content string"))
    files = [("a.py", "key_none\nkey_some key_all\nfoo"), ("vendor/a.py", "key_zzz bar"), ("a.js", "key_zzz\nbar")]
    got = R.matches(spark.createDataFrame(files, "path string, content string"), rules).collect()
    assert sorted((x.path, x.line, x.rule_id) for x in got) == [("a.js", 2, "one of"), ("a.py", 2, "both"), ("a.py", 3, "one of"), ("vendor/a.py", 1, "one of")]
