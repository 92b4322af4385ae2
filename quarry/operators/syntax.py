"""Classes, functions and methods of JavaScript and TypeScript sources, by a tokenizer and matched brackets.

Strings, templates (with the code inside them), regular expressions and comments are told apart from
code, so braces in them don't count. On the tokens, nodes are found where a grammar has them: classes and
what they extend, static blocks, functions, arrow functions and function types, methods of classes and
objects, and signatures without a body."""

from __future__ import annotations

import re
from dataclasses import dataclass

_TOKEN = re.compile(
    r"(?P<space>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<word>[#\w$]+)|(?P<string>\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*')|(?P<punct>=>|\.\.\.|\?\.|[=!]==?|[<>]=|&&|\|\||\?\?|\+\+|--|\*\*|.)", re.DOTALL
)
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/\w*")
#: After these words an expression begins; these are no names of methods; these may stand before one.
_OPERATORS = frozenset(("return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "do", "else", "yield", "await", "instanceof", "extends", "default"))
_CONTROL = frozenset(("if", "for", "while", "switch", "catch", "function", "return", "with", "super", "new", "typeof", "await", "import", "throw", "else", "do", "in", "of"))
_MODIFIERS = frozenset(("public", "private", "protected", "static", "async", "get", "set", "readonly", "override", "abstract", "declare", "accessor"))
_PAIRS = {")": "(", "]": "[", "}": "{"}


@dataclass
class Token:
    kind: str
    text: str
    start: int
    end: int
    line: int


def tokens_of(source: str) -> list[Token]:
    out: list[Token] = []
    templates: list[int] = []  # open braces within each template's code
    at, line = 0, 1

    def add(kind: str, end: int) -> None:
        nonlocal at, line
        if kind != "space":
            out.append(Token(kind, source[at:end], at, end, line))
        line += source.count("\n", at, end)
        at = end

    def template(start: int) -> None:
        """The rest of a template's text, up to its end or to code in it."""
        k = start
        while k < len(source):
            if source[k] == "\\":
                k += 2
            elif source[k] == "`":
                return add("string", k + 1)
            elif source.startswith("${", k):
                add("string", k)
                add("punct", k + 2)
                templates.append(0)
                return None
            else:
                k += 1
        return add("string", len(source))

    while at < len(source):
        c = source[at]
        if c == "`":
            template(at + 1)
            continue
        if c == "}" and templates and not templates[-1]:
            templates.pop()
            add("punct", at + 1)
            template(at)
            continue
        if c == "/" and source[at : at + 2] not in ("//", "/*") and (not out or out[-1].text in _OPERATORS or (out[-1].kind == "punct" and out[-1].text not in (")", "]", "}"))) and (m := _REGEX.match(source, at)):
            add("string", m.end())
            continue
        if templates and c in "{}":
            templates[-1] += 1 if c == "{" else -1
        m = _TOKEN.match(source, at)
        add(m.lastgroup, m.end())
    return out


def _matches(tokens: list[Token]) -> dict[int, int]:
    """Brackets that belong together, both ways; open ones end with the source."""
    out: dict[int, int] = {}
    stack: list[int] = []
    for k, t in enumerate(tokens):
        if t.kind != "punct":
            continue
        if t.text in ("(", "[", "{", "${"):
            stack.append(k)
        elif t.text in _PAIRS:
            while stack and tokens[stack[-1]].text.lstrip("$") != _PAIRS[t.text]:
                stack.pop()
            if stack:
                out[k] = stack.pop()
                out[out[k]] = k
    return out


class Finder:
    def __init__(self, source: str):
        self.source, self.t = source, tokens_of(source)
        self.match = _matches(self.t)
        self.found: list[tuple[str, str | None, int, int]] = []  # type, name, first and last token
        self.bodies: dict[int, str] = {}  # opening braces of classes and interfaces

    def text(self, k: int) -> str:
        return self.t[k].text if 0 <= k < len(self.t) else ""

    def _angles(self, k: int) -> int:
        """Past a list of type parameters at k, if there is one."""
        if self.text(k) != "<":
            return k
        depth = 0
        while k < len(self.t):
            x = self.text(k)
            if x in ("(", "[", "{"):
                k = self.match.get(k, len(self.t))
            depth += (x == "<") - (x == ">")
            k += 1
            if not depth:
                break
        return k

    def _type(self, k: int) -> int:
        """Past a type at k."""
        need = True  # an operand
        while k < len(self.t):
            x, kind = self.text(k), self.t[k].kind
            if need:
                if x in ("(", "[", "{"):
                    k = self.match.get(k, len(self.t)) + 1
                    if x == "(" and self.text(k) == "=>":
                        k += 1
                        continue
                    need = False
                elif x in ("keyof", "typeof", "readonly", "infer", "asserts", "unique", "new", "|", "&"):
                    k += 1
                elif kind in ("word", "string"):
                    k, need = k + 1, False
                else:
                    return k
            elif x in (".", "|", "&", "is", "extends", "?."):
                k, need = k + 1, True
            elif x == "<":
                k = self._angles(k)
            elif x == "[" and self.t[k].line == self.t[k - 1].line:
                k = self.match.get(k, len(self.t)) + 1
            else:
                return k
        return k

    def _after_parameters(self, k: int) -> int:
        """Past the parameters that open at k and a return type."""
        k = self.match.get(k, len(self.t)) + 1
        return self._type(k + 1) if self.text(k) == ":" else k

    def _back(self, k: int, words: frozenset[str]) -> int:
        """The first of the modifiers that stand before k."""
        while self.text(k - 1) in words or (self.text(k - 1) == "*" and self.text(k - 2) in ("", "{", "}", ";", ",", "async", "static")):
            k -= 1
        return k

    def _expression_end(self, k: int) -> int:
        """The last token of the expression that begins at k."""
        last = k
        while k < len(self.t):
            x = self.text(k)
            if x in (",", ";", ")", "]", "}", ":") or (x == ">" and self.text(k - 1) != "="):
                break
            if k > last and self.t[k].line > self.t[last].line and self.t[k].kind in ("word", "string") and self.t[last].kind != "punct" and x not in ("in", "of", "instanceof", "as"):
                break
            if k > last and self.t[k].line > self.t[last].line and self.text(last) in (")", "]", "}") and self.t[k].kind == "word" and x not in ("in", "of", "instanceof", "as"):
                break
            last = self.match[k] if x in ("(", "[", "{", "${") and k in self.match else k
            k = last + 1
        return last

    def _class(self, k: int) -> None:
        after = self.text(k + 1)
        if self.text(k - 1) in (".", "?.") or after in (":", "=", ",", ")", "(", "?"):
            return
        named = after not in ("extends", "implements", "{") and after != ""
        head = self._angles(k + 2 if named else k + 1)
        body = head
        while body < len(self.t) and self.text(body) != "{":
            body = self._angles(body) if self.text(body) == "<" else self.match.get(body, body) + 1 if self.text(body) in ("(", "[") else body + 1
        if body not in self.match:
            return
        if body > head:
            self.found.append(("class", None, head, body - 1))
        self.bodies[body] = "class"
        first = k - 1 if self.text(k - 1) == "abstract" else k
        self.found.append(("class", after if named else None, first, self.match[body]))

    def _function(self, k: int) -> None:
        if self.text(k - 1) in (".", "?.") or self.text(k + 1) in (":", "=", ","):
            return
        name = k + 1 + (self.text(k + 1) == "*")
        named = self.text(name) not in ("(", "<")
        opens = self._angles(name + named)
        if self.text(opens) != "(" or opens not in self.match:
            return
        body = self._after_parameters(opens)
        end = self.match.get(body, len(self.t) - 1) if self.text(body) == "{" else body if self.text(body) == ";" else body - 1
        first = k - 1 if self.text(k - 1) == "async" else k
        self.found.append(("function", self.text(name) if named else None, first, end))

    def _arrow(self, first: int, arrow: int) -> None:
        if self.text(first - 1) == ">":  # type parameters
            depth, k = 0, first - 1
            while k >= 0:
                depth += (self.text(k) == ">") - (self.text(k) == "<")
                if not depth:
                    first = k
                    break
                k -= 1
        first -= self.text(first - 1) == "async"
        body = arrow + 1
        end = self.match.get(body, len(self.t) - 1) if self.text(body) == "{" else self._expression_end(body)
        line = self.source[self.t[first].start : self.t[min(end, len(self.t) - 1)].end].split("\n")[0]
        named = re.search(r"class\s+(\w+)", line, re.ASCII) or re.search(r"function\s+(\w+)", line, re.ASCII) or re.search(r"def\s+(\w+)", line, re.ASCII)
        self.found.append(("function", named[1] if named else None, first, end))

    def _method(self, k: int, holder: str | None) -> None:
        """A name (or a computed one that ends at k) before an opening parenthesis."""
        first = self.match.get(k, k) if self.text(k) == "]" else k
        opens = self._angles(k + 1 + (self.text(k + 1) == "?"))
        if self.text(opens) != "(" or opens not in self.match or self.text(first) in _CONTROL:
            return
        start = self._back(first, _MODIFIERS)
        before = self.text(start - 1)
        if holder is None and before not in ("{", ","):
            return
        if holder is not None and before in (".", "?.", "=", "=>", ":", "(", "@", "new", "!", "&&", "||", "??", "return"):
            return
        body = self._after_parameters(opens)
        if self.text(body) == "{" and body in self.match:
            end = self.match[body]
        elif holder is not None and (self.text(body) in (";", ",", "}") or self.t[min(body, len(self.t) - 1)].line > self.t[body - 1].line):
            end = body - 1
        else:
            return
        self.found.append(("function", self.source[self.t[first].start : self.t[k].end], start, end))

    def nodes(self) -> list[dict]:
        holders: list[str | None] = []
        for k, t in enumerate(self.t):
            if t.text in ("{", "${") and t.kind == "punct":
                holders.append(self.bodies.get(k))
            elif t.text == "}" and t.kind == "punct" and holders:
                holders.pop()
            elif t.kind == "word" or (t.text == "]" and t.kind == "punct") or (t.kind == "string" and holders):
                holder = holders[-1] if holders else None
                if t.text == "class" and self.text(k - 1) != ".":
                    self._class(k)
                elif t.text == "interface" and self.t[min(k + 1, len(self.t) - 1)].kind == "word":
                    body = k + 2
                    while body < len(self.t) and self.text(body) != "{":
                        body = self._angles(body) if self.text(body) == "<" else body + 1
                    self.bodies[body] = "interface"
                elif t.text == "function":
                    self._function(k)
                elif t.text == "static" and holder == "class" and self.text(k + 1) == "{" and k + 1 in self.match:
                    self.found.append(("class", None, k, self.match[k + 1]))
                elif self.text(k + 1) == "=>" and t.kind == "word" and self.text(k - 1) not in (":", "."):
                    self._arrow(k, k + 1)
                elif self.text(k + 1) in ("(", "<", "?") and holders:
                    self._method(k, holder)
            elif t.text == "(" and k in self.match:
                after = self._after_parameters(k)
                if self.text(after) == "=>":
                    self._arrow(k, after)
        return self._sorted()

    def _sorted(self) -> list[dict]:
        spans = sorted({(self.t[a].start, -self.t[min(b, len(self.t) - 1)].end, kind, name or "") for kind, name, a, b in self.found})
        out, open_ = [], []
        for start, end, kind, name in spans:
            while open_ and open_[-1] <= start:
                open_.pop()
            out.append((self.source.count("\n", 0, start) + 1, len(open_), start, {"type": kind, "name": name or None, "content": self.source[start:-end], "start": self.source.count("\n", 0, start) + 1, "end": self.source.count("\n", 0, -end) + 1}))
            open_.append(-end)
        return [x[3] for x in sorted(out, key=lambda x: x[:3])]


def nodes(source: str) -> list[dict]:
    """``type, name, content, start, end`` (lines from 1) by first line, outer nodes first."""
    return Finder(source).nodes()


