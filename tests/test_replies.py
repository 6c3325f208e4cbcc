"""JSON in texts against a plain version that tries every candidate on its own."""

import json
import random
import re

from riskweave.sources import replies as R


def balanced(text, start):
    stack, inside, escaped = "", False, False
    for i in range(start, len(text)):
        c = text[i]
        if inside:
            inside, escaped = escaped or c != '"', c == "\\" and not escaped
        elif c == '"':
            inside = True
        elif c in "{[":
            stack += c
        elif c in "}]":
            if stack[-1:] + c not in ("{}", "[]"):
                return None
            stack = stack[:-1]
            if not stack:
                return text[start : i + 1]


def close(text):
    text = text.rstrip()
    text = text[:-1] if text.endswith(",") else text
    return text + "]" * (text.count("[") - text.count("]")) + "}" * (text.count("{") - text.count("}"))


def brute(content, cut_off):
    sources = [R.without_reasoning(content), content]
    tries = [m[1].strip() for s in sources for m in re.finditer(r"(?is)```(?:json)?\s*(.*?)```", s)]
    for s in sources:
        at = [i for i, c in enumerate(s) if c in "{["]
        spans = [balanced(s, i) for i in at]
        tries += [s.strip(), *filter(None, spans)] + [s[i:].strip() for i, x in zip(at, spans) if not x][:1]
    objects = []
    for text in dict.fromkeys(filter(None, tries)):
        try:
            value = json.loads(text)
        except ValueError:
            try:
                value = json.loads(close(text))
            except ValueError:
                continue
            if cut_off and value is not None:
                return value, "closed"
            continue
        if isinstance(value, dict):
            objects.append(value)
    if objects:
        return max(objects, key=lambda x: len(json.dumps(x, sort_keys=True))), "parsed"
    try:
        value = json.loads(close(sources[0])) if cut_off else None  # no object, but still a value
    except ValueError:
        value = None
    return (value, "closed") if value is not None else (None, "none")


def value(r, depth=3):
    kind = r.randint(0, 6 if depth else 3)
    if kind < 2:
        return r.choice([1, 2.5, None, True, ""])
    if kind < 4:
        return "".join(r.choice('a{}[]"\\,é\n') for _ in range(r.randint(0, 5)))
    if kind == 4:
        return [value(r, depth - 1) for _ in range(r.randint(0, 3))]
    return {r.choice("abcd{"): value(r, depth - 1) for _ in range(r.randint(0, 3))}


def texts():
    r = random.Random(7)
    bits = ["so ", "{", "}", "[", "]", '"', "\\", "```json\n", "```", "<think>", "</think>", "[analysis]", "[/analysis]", ", ", "\n", "<reasoning x>"]
    for _ in range(1500):
        parts = [json.dumps(value(r)) if r.random() < 0.5 else r.choice(bits) for _ in range(r.randint(0, 7))]
        text = "".join(parts)
        yield text[: r.randint(0, len(text))] if r.random() < 0.4 else text


def test_against_every_candidate(spark):
    rows = [(i, t, c) for i, t in enumerate(texts()) for c in (False, True)]
    hows = set()
    for _, t, c in rows:
        got = R.found(t, c) if t else (None, "none")
        assert got == (brute(t, c) if t else (None, "none")), (t, c)
        hows.add(got[1])
    assert hows == {"parsed", "closed", "none"}
    df = spark.createDataFrame([*rows, (-1, None, None), (-2, "", True)], "id long, content string, cut_off boolean").repartition(3)
    for x in R.json_of(df).collect():
        want = brute(x.content, x.cut_off) if x.content else (None, "none")
        assert (json.loads(x.json) if x.json else None, x.how) == want
    assert R.json_of(df.limit(0)).count() == 0


def test_partners_of_every_opener():
    for t in texts():
        ends = R.partners(t)
        assert sorted(ends) == [i for i, c in enumerate(t) if c in "{["]
        for i, e in ends.items():
            assert (t[i:e] if e else None) == balanced(t, i), t


def test_long_texts_take_few_scans():
    assert R.found("[" * 60_000 + '{"a": 1}' + '{"b": "' * 20_000, False) == ({"a": 1}, "parsed")
    assert R.found('{"a": ' * 50_000, True) == (None, "none")
