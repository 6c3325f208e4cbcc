"""Where declarations of a source file begin and end.

Contents of strings and comments are blanked, so that what is left is code at the same places;
brackets are paired; and a declaration reaches from its header to the end of its body. A place belongs
to the innermost declaration around it. One pass each, in time linear in the file, a template's
expressions included."""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

BRACES = frozenset("javascript typescript java kotlin php go rust c cpp csharp scala swift".split())
#: Languages that declare functions without a word for it, as ``name(...) {``.
BARE = frozenset("javascript typescript java c cpp csharp".split())
#: Languages in which the end of a line may end a declaration that has no body.
LINES = frozenset("kotlin go scala swift javascript typescript".split())
#: Words before a parenthesis and a block that declare nothing.
CONTROL = frozenset("if for while switch catch return function new foreach using lock fixed synchronized when match do else try sizeof typeof await yield with elseif constexpr defined __attribute__ alignas decltype".split())
#: Those of them that belong to one language and are calls in others.
CONTROL_OF = {"javascript": {"async"}, "typescript": {"async"}, "csharp": {"using", "lock", "fixed", "foreach"}, "java": {"synchronized"}, "kotlin": {"when"}, "rust": {"match"}, "php": {"foreach", "elseif"}, "cpp": {"alignas", "decltype"}, "c": {"__attribute__"}}
#: Words that can stand before a call, but before no declared name.
BEFORE_CALLS = frozenset("return new await else throw yield case in goto not and or of delete typeof do".split())

_line, _block, _open_block = r"//[^\n]*", r"/\*.*?(?:\*/|\Z)", r"/\*"
_double, _single = r'"(?:\\.|[^"\\\n])*"', r"'(?:\\.|[^'\\\n])*'"
_three = r'""".*?(?:"""|\Z)'
_regex = r"(?<=[(,=:\[!&|?{};\n])[ \t]*/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*"
_char = r"'(?:\\[^\n']*|[^'\\\n])'"
_define = r"^[ \t]*#[ \t]*define\b(?:\\\n|[^\n])*"
_cpp_raw = r'R"([^()\s\\]{0,16})\(.*?(?:\)\1"|\Z)'
_rust_raw = r'\br(#*)".*?(?:"\1|\Z)'
_php = (_line, r"#(?!\[)[^\n]*", _block, r"<<<[ \t]*['\"]?(\w+)['\"]?\n.*?(?:\n[ \t]*\1\b|\Z)", r'"(?:\\.|[^"\\])*"', r"'(?:\\.|[^'\\])*'")
_script = (_line, _block, _double, _single, "`", _regex)
_ruby = (r"^=begin\b.*?(?:^=end\b[^\n]*|\Z)", r"#[^\n]*", r'"(?:\\.|[^"\\])*"', r"'(?:\\.|[^'\\])*'", r"%[wWiIqQ]?(?:\[[^\]]*\]|\([^)]*\)|\{[^}]*\})", _regex)
_kinds = {
    "javascript": _script,
    "typescript": _script,
    "java": (_line, _block, _three, _double, _char),
    "csharp": (_line, _block, r'[$@]*@[$@]*"(?:""|[^"])*"', _three, _double, _char),
    "kotlin": (_line, _open_block, _three, _double, _char),
    "scala": (_line, _open_block, _three, _double, _char),
    "swift": (_line, _open_block, _three, _double),
    "rust": (_line, _open_block, _rust_raw, r'"(?:\\.|[^"\\])*"', _char),
    "go": (_line, _block, _double, r"`[^`]*`", _char),
    "c": (_line, _block, _define, _double, _char),
    "cpp": (_line, _block, _define, _cpp_raw, _double, _char),
    "php": _php,
    "ruby": _ruby,
}
_tokens = {k: re.compile("|".join(f"(?:{p})" for p in v), re.DOTALL | re.MULTILINE) for k, v in _kinds.items()}
_tokens["javascript"] = _tokens["typescript"] = re.compile(_tokens["javascript"].pattern + r"|[{}]", re.DOTALL | re.MULTILINE)
_template = re.compile(r"\\.|`|\$\{", re.DOTALL)
_nested = re.compile(r"/\*|\*/")
_visible = re.compile(r"[^\n]")


def blanked(text: str, language: str) -> str:
    """The text with blanks for what stands in comments and strings; quotes, lines and lengths stay."""
    token = _tokens.get(language)
    if not token:
        return text
    out, pos, template, open_ = [], 0, False, []

    def blank(a: int, b: int):
        piece = text[a:b]
        quoted = len(piece) > 1 and piece[0] in "\"'`" and piece[-1] == piece[0]
        out.append(piece[0] + _visible.sub(" ", piece[1:-1]) + piece[-1] if quoted else _visible.sub(" ", piece))

    while pos < len(text):
        m = (_template if template else token).search(text, pos)
        if not m:
            blank(pos, len(text)) if template else out.append(text[pos:])
            break
        if template:
            blank(pos, m.end())
            if m[0] == "`":
                template = False
            elif m[0] == "${":
                template = False
                open_.append(0)
            pos = m.end()
            continue
        out.append(text[pos : m.start()])
        pos = m.end()
        if m[0] == "`" and language in ("javascript", "typescript"):
            template = True
            out.append(" ")
        elif m[0] in ("{", "}") and language in ("javascript", "typescript"):
            if open_ and m[0] == "}" and not open_[-1]:
                open_.pop()
                template = True
                out.append(" ")
                continue
            if open_:
                open_[-1] += 1 if m[0] == "{" else -1
            out.append(m[0])
        elif m[0] == "/*":
            # comments that nest
            depth = 1
            while depth and (n := _nested.search(text, pos)):
                depth, pos = depth + (1 if n[0] == "/*" else -1), n.end()
            pos = len(text) if depth else pos
            blank(m.start(), pos)
        else:
            blank(m.start(), m.end())
    return "".join(out)


def pairs(code: str) -> dict[int, int]:
    """The place after the closing sign of each opening one. A brace closes what is open inside it."""
    out, stack = {}, []
    for m in re.finditer(r"[()\[\]{}]", code):
        sign = m[0]
        if sign in "([{":
            stack.append((m.start(), sign))
            continue
        opener = {")": "(", "]": "[", "}": "{"}[sign]
        if sign == "}":
            while stack and stack[-1][1] != "{":
                stack.pop()
        if stack and stack[-1][1] == opener:
            out[stack.pop()[0]] = m.end()
    return out


@dataclass
class Scope:
    """A declaration: its kind (function, class, or block for one without a fact), where its header
    begins, its name stands and it ends, and the scope around it."""

    kind: str
    name: str
    start: int
    at: int
    end: int
    around: Scope | None = None

    def owner(self, kind: str) -> str | None:
        """The name of the innermost such declaration from here outwards."""
        scope: Scope | None = self
        while scope and scope.kind != kind and not (kind == "class" and scope.kind == "block"):
            scope = scope.around
        return scope.name if scope else None


_head = re.compile(r"[^(){}\[\];=\n]*+")
_goes_on = re.compile(r"\s*(?:\{|=|:|->|where\b|throws\b|with\b|\()")


def body_end(code: str, pos: int, closes: dict[int, int], language: str) -> int | None:
    """The end of the body of a declaration whose name ends at a place; None if it has no body."""
    n = len(code)
    while pos < n:
        pos = _head.match(code, pos).end()
        sign = code[pos] if pos < n else ";"
        if sign in "([":
            pos = closes.get(pos, n)
        elif sign == "{":
            # members that are initialised in braces
            end = closes.get(pos, n)
            if language == "cpp" and re.search(r"[:,]\s*\w+$", code[max(0, pos - 80) : pos]) and re.match(r"\s*[,{]", code[end : end + 80]):
                pos = end
                continue
            return end
        elif sign == "=":
            if code.startswith("=>", pos) or language in ("kotlin", "scala"):
                return expression_end(code, pos + (2 if code.startswith("=>", pos) else 1), closes)
            if language in ("c", "cpp", "csharp", "java", "rust"):
                return None  # a value, or a function without a body
            pos += 1
        elif sign == "\n":
            if language in LINES and not _goes_on.match(code, pos):
                return None
            pos += 1
        else:
            return None
    return None


def expression_end(code: str, pos: int, closes: dict[int, int]) -> int:
    """The end of a body that is an expression, in braces or not."""
    first = re.compile(r"\s*").match(code, pos).end()
    if code[first : first + 1] == "{":
        return closes.get(first, len(code))
    pos = first
    while pos < len(code):
        sign = code[pos]
        if sign in "([{":
            pos = closes.get(pos, len(code))
        elif sign in ";)]},":
            return pos
        elif sign == "\n" and not re.compile(r"\s*[.?:&|+]").match(code, pos):
            return pos
        else:
            pos += 1
    return len(code)


def _ruby_ends(code: str) -> dict[int, int]:
    """Where the block of each opening word ends."""
    out, stack, loop_line = {}, [], -1
    for m in re.finditer(r"(?<![.:@$\w])(def|class|module|if|unless|while|until|case|begin|do|for|end)\b(?![:?!])", code):
        word, start = m[1], m.start()
        line = code.rfind("\n", 0, start) + 1
        before = code[line:start].rstrip()
        if word == "end":
            if stack:
                out[stack.pop()] = m.end()
        elif word in ("if", "unless", "while", "until") and before and not re.search(r"(?:[=(,;|&{]|\b(?:then|else|do|return|and|or|not))$", before):
            continue  # a condition behind its statement
        elif word == "do" and loop_line == line:
            continue
        elif word == "def" and re.compile(r"def\s+[\w.?!]+(?:\([^()\n]*\))?\s*=[^=~>]").match(code, start):
            out[start] = (code.find("\n", start) + 1 or len(code) + 1) - 1
        else:
            loop_line = line if word in ("while", "until", "for") else loop_line
            stack.append(start)
    return out


def scopes(code: str, language: str, found: list[tuple[str, str, int, int]], call) -> list[Scope]:
    """Scopes of blanked code in order, given declarations (kind, name, start, place of the name) that
    patterns have found; ``call`` matches names before parentheses."""
    ruby = language == "ruby"
    closes = _ruby_ends(code) if ruby else pairs(code)
    out, names = [], set()
    for kind, name, start, at in found:
        names.add(at)
        if ruby:
            word = re.compile(r"\s*").match(code, start).end()
            end = closes.get(word, len(code))
        else:
            end = body_end(code, at + len(name), closes, language)
        out.append(Scope(kind, name, start, at, end if end is not None else _line_end(code, at)))
    if language in BARE:
        out += _bare(code, language, closes, names, call, out)
    out.sort(key=lambda s: (s.start, -s.end))
    stack: list[Scope] = []
    for s in out:
        while stack and stack[-1].end <= s.start:
            stack.pop()
        s.around = stack[-1] if stack else None
        if s.around:
            s.end = min(s.end, s.around.end)
        stack.append(s)
    return out


def _line_end(code: str, at: int) -> int:
    end = code.find("\n", at)
    return len(code) if end < 0 else end


def _bare(code: str, language: str, closes: dict[int, int], names: set[int], call, known: list[Scope]) -> list[Scope]:
    """Functions that stand as ``name(...) {``. Inside a function one needs a type before its name, so
    that a call before a block is none; scripts have no such calls."""
    script = language in ("javascript", "typescript")
    out: list[Scope] = []
    outer = sorted(known, key=lambda s: s.start)
    stack: list[Scope] = []
    k = 0
    for m in call.finditer(code):
        at, name, open_ = m.start(2), m[2], m.end() - 1
        if at in names or name in CONTROL or name.isdigit() or open_ not in closes or code[at - 1 : at] == "@":
            continue
        if m[1] and language not in ("c", "cpp"):
            continue
        while k < len(outer) and outer[k].start <= at:
            stack.append(outer[k])
            k += 1
        stack = [s for s in stack if s.end > at]
        line = code.rfind("\n", 0, at) + 1
        before = re.search(r"([\w>\]?*&~]+)\s*(?:\w+\s*(?:\.|::|->)\s*)?$", code[max(line, at - 120) : at])
        word = before[1] if before else ""
        close = closes[open_]
        if word == "new":
            # a class without a name
            if code[close : close + 40].lstrip()[:1] == "{":
                stack.append(Scope("block", name, at, at, closes.get(code.index("{", close), len(code))))
            continue
        inside = max(stack, key=lambda s: s.start, default=None)
        if not script and inside and inside.kind == "function" and (not word or word in BEFORE_CALLS):
            continue
        tail = code[close : close + 40].lstrip()
        short = tail.startswith("=>")
        if tail[:1] in (".", ")", ",", ";") or short and (language != "csharp" or not word or word in BEFORE_CALLS):
            continue
        end = body_end(code, close, closes, language)
        if end is None or code[end - 1] != "}" and not short:
            continue
        head = code[line:at]
        start = at if re.search("[{};]", head) else line + len(head) - len(head.lstrip())
        out.append(Scope("function", name, start, at, end))
        stack.append(out[-1])
        names.add(at)
    return out


def declares(code: str, at: int) -> bool:
    """Does a type stand before a name, so that what looks like a call outside of functions is none?"""
    before = re.search(r"(?:(\w+)[\s*&]|[>\]][\s*&]*)\s*$", code[max(code.rfind("\n", 0, at) + 1, at - 80) : at])
    return bool(before) and before[1] not in BEFORE_CALLS


class Index:
    """Finds the innermost scope around a place."""

    def __init__(self, all_scopes: list[Scope]):
        edges: list[tuple[int, Scope | None]] = []
        stack: list[Scope] = []
        for s in all_scopes:
            while stack and stack[-1].end <= s.start:
                edges.append((stack[-1].end, stack[-1].around))
                stack.pop()
            edges.append((s.start, s))
            stack.append(s)
        while stack:
            edges.append((stack[-1].end, stack[-1].around))
            stack.pop()
        # of edges at one place the last holds
        self.places = [p for p, _ in edges]
        self.scopes = [s for _, s in edges]

    def around(self, at: int) -> Scope | None:
        i = bisect_right(self.places, at) - 1
        return self.scopes[i] if i >= 0 else None
