"""Symbols and raw references of TypeScript files, under the same contract as the Python pack.

Read from tokens and matching brackets, not from a grammar, so a broken file gives what can be told.
Classes, interfaces and enums are classes; their members, functions, and functions held by a constant
are functions and methods; other declarations at the top level and fields are variables. Imports name
`module.name` with relative modules taken from the file's folder; calls count for the enclosing symbol,
and `this.x` is written `self.x`, as resolution knows it.
"""

from __future__ import annotations

import posixpath
import re

from .python_source import Parsed, count_lines

_TOKEN = re.compile(
    r"(?P<skip>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<text>\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?|`(?:\\.|[^`\\])*`?)|(?P<name>[A-Za-z_$][\w$]*)|(?P<number>\d[\w.]*)|(?P<mark>=>|\?\.|\.\.\.|.)",
    re.DOTALL,
)
_REGEX = re.compile(r"/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
_OPENS, _CLOSES = {"(": ")", "[": "]", "{": "}"}, {")": "(", "]": "[", "}": "{"}
#: Words after which a slash begins a regular expression, and words that a call's name is not.
_BEFORE_REGEX = frozenset("return typeof case in of delete void throw new else do".split())
_NO_CALL = frozenset("if for while switch catch return typeof function await yield throw super import void delete in of with constructor else do case".split())
_MODIFIERS = frozenset("export default declare abstract async public private protected static readonly override get set accessor".split())


class _Tokens:
    def __init__(self, text: str) -> None:
        self.kind: list[str] = []
        self.text: list[str] = []
        self.line: list[int] = []
        self.begin: list[int] = []
        at, line = 0, 1
        while at < len(text):
            found = None
            if text[at] == "/" and self._regex_may_begin():
                found = _REGEX.match(text, at)
            kind = "text" if found else None
            if found is None:
                found = _TOKEN.match(text, at)
                kind = found.lastgroup
            if kind != "skip":
                self.kind.append(kind)
                self.text.append(found[0])
                self.line.append(line)
                self.begin.append(at)
            line += found[0].count("\n")
            at = found.end()
        self.match = self._matches()

    def _regex_may_begin(self) -> bool:
        if not self.text:
            return True
        last = self.text[-1]
        return last in _BEFORE_REGEX if self.kind[-1] == "name" else self.kind[-1] == "mark" and last not in ")]}"

    def _matches(self) -> dict[int, int]:
        """Places of closing brackets by those of the opening ones; one that is never closed reaches to the end."""
        out, stack = {}, []
        for i, x in enumerate(self.text):
            if self.kind[i] != "mark":
                continue
            if x in _OPENS:
                stack.append(i)
            elif x in _CLOSES and any(self.text[k] == _CLOSES[x] for k in stack[-3:]):
                while self.text[stack[-1]] != _CLOSES[x]:
                    out[stack.pop()] = i
                out[stack.pop()] = i
        for i in stack:
            out[i] = len(self.text)
        return out

    def __len__(self) -> int:
        return len(self.text)

    def at(self, i: int) -> str:
        return self.text[i] if 0 <= i < len(self.text) and self.kind[i] != "text" else ""


def module_name(path: str) -> str:
    parts = re.sub(r"(\.d)?\.tsx?$", "", path).split("/")
    return ".".join(parts[:-1] if len(parts) > 1 and parts[-1] == "index" else parts)


class _Reader:
    def __init__(self, path: str, text: str) -> None:
        self.path, self.source, self.t = path, text, _Tokens(text)
        self.out = Parsed(path, count_lines(text))

    def symbol(self, kind: str, scope: str | None, name: str, first: int, last: int, signature: str | None = None) -> str:
        qualified = f"{scope}.{name}" if scope else module_name(self.path)
        last_line = self.t.line[min(last, len(self.t) - 1)] if len(self.t) else 1
        begin, end = (1, max(self.out.n_lines, 1)) if kind == "file" else (self.t.line[first], last_line)
        self.out.symbols.append({
            "symbol_seq": len(self.out.symbols), "kind": kind, "name": name, "qualified_name": qualified, "start_line": begin, "end_line": max(begin, end),
            "signature": signature, "docstring": None, "parent_qualified_name": scope,
        })
        return qualified

    def reference(self, kind: str, source: str, target: str, line: int) -> None:
        self.out.references.append({"ref_seq": len(self.out.references), "kind": kind, "src_qualified_name": source, "target_text": target, "evidence_line": line})

    def dotted(self, i: int) -> tuple[str, int]:
        """A name with its members from place i on, and the place behind it."""
        parts, t = [self.t.at(i)], self.t
        i += 1
        while t.at(i) in (".", "?.") and i + 1 < len(t) and t.kind[i + 1] == "name":
            parts.append(t.at(i + 1))
            i += 2
        return ".".join(parts), i

    def behind_types(self, i: int) -> int:
        """The place behind `<...>` if one begins at i."""
        depth, at = 0, i
        while at < len(self.t):
            x = self.t.at(at)
            depth += (x == "<") - (x == ">")
            if x in _OPENS:
                at = self.t.match[at]
            if depth <= 0:
                return at + 1 if at > i or x == ">" else i
            at += 1
        return i

    def end_of(self, i: int, end: int) -> int:
        """The last token of a statement from i on: at a semicolon, or before a new line that does not go on."""
        while i < end:
            x = self.t.at(i)
            if x in _OPENS:
                i = min(self.t.match[i], end - 1)
            if x == ";" or i + 1 >= end:
                return i
            following = self.t.at(i + 1)
            if self.t.line[i + 1] > self.t.line[i] and following not in (".", "?.", "=>", "=", "+", "?", ":", "(", "[", "{", ",", "|", "&") and self.t.at(i) not in ("=>", "=", "+", "?", ":", ",", ".", "|", "&", "("):
                return i
            i += 1
        return end - 1

    def calls(self, i: int, end: int, source: str) -> None:
        t = self.t
        while i < end:
            if t.kind[i] != "name" or t.at(i) in _NO_CALL or t.at(i - 1) in (".", "?."):
                i += 1
                continue
            target, after = self.dotted(i)
            behind = self.behind_types(after) if t.at(after) == "<" else after
            if t.at(behind) == "(" and t.at(t.match[behind] + 1) not in ("=>", "{"):
                self.reference("calls", source, re.sub(r"^this\.", "self.", target), t.line[i])
            i = after

    def signature(self, name: str, open_: int) -> str:
        close = self.t.match[open_]
        stop = self.t.begin[close] + 1 if close < len(self.t) else len(self.source)
        return name + " ".join(self.source[self.t.begin[open_] : stop].split())

    def imports(self, i: int, end: int, source: str) -> None:
        t, last = self.t, self.end_of(i, end)
        texts = [k for k in range(i, last + 1) if t.kind[k] == "text"]
        if not texts:
            return
        given = t.text[texts[-1]].strip("\"'`")
        if given.startswith("."):
            given = posixpath.normpath(posixpath.join(posixpath.dirname(self.path), given))
            if given.startswith(".."):
                return
        module = module_name(given).replace("/", ".").strip(".")
        names = []
        open_ = next((k for k in range(i, texts[-1]) if t.at(k) == "{"), None)
        if open_ is not None:
            k = open_ + 1
            while k < t.match[open_]:
                if t.at(k) == "type" and t.kind[k + 1] == "name" and t.at(k + 1) != "as":
                    k += 1
                if t.kind[k] == "name":
                    names.append(t.at(k))
                while k < t.match[open_] and t.at(k) != ",":
                    k += 1
                k += 1
        for name in names or [None]:
            self.reference("imports", source, f"{module}.{name}" if name else module, t.line[i])

    def function(self, i: int, end: int, scope: str, first: int, kind: str, name: str) -> int:
        """A function whose parameters begin at i; the place behind it."""
        body = self.t.match[i] + 1
        while body < end and self.t.at(body) not in ("{", ";", "}") and not (self.t.at(body) == "=" and self.t.at(body + 1)):
            if self.t.line[min(body, len(self.t) - 1)] > self.t.line[body - 1] and self.t.at(body) not in (":", "=>"):
                break
            body += 1
        last = self.t.match.get(body, body) if self.t.at(body) == "{" else body - 1
        own = self.symbol(kind, scope, name, first, min(last, end - 1), self.signature(name, i))
        self.decorated(first, own)
        if self.t.at(body) == "{":
            self.block(body + 1, min(self.t.match[body], end), own, top=False)
            return self.t.match[body] + 1
        return body

    def decorated(self, first: int, own: str) -> None:
        for k, target in self.held:
            self.reference("references", own, target, self.t.line[first])
        self.held = []

    def type_body(self, i: int, end: int, scope: str, first: int, word: str) -> int:
        """A class, interface or enum whose name is at i; the place behind it."""
        name, at, bases = self.t.at(i), i + 1, []
        if self.t.at(at) == "<":
            at = self.behind_types(at)
        while at < end and self.t.at(at) != "{":
            if self.t.kind[at] == "name" and self.t.at(at) not in ("extends", "implements"):
                target, after = self.dotted(at)
                if self.t.at(after) != "(":
                    bases.append(target)
                at = self.behind_types(after) if self.t.at(after) == "<" else after
            else:
                at += 1
        last = min(self.t.match.get(at, end), end - 1)
        own = self.symbol("class", scope, name, first, last)
        self.decorated(first, own)
        for b in bases:
            self.reference("inherits", own, b, self.t.line[i])
        if word != "enum" and at < end:
            self.members(at + 1, min(self.t.match[at], end), own)
        return last + 1

    def members(self, i: int, end: int, scope: str) -> None:
        t = self.t
        while i < end:
            first = i
            i = self.decorators(i)
            while i < end and (t.at(i) == "*" or t.at(i) in _MODIFIERS and t.at(i + 1) not in ("(", "=", ":", ";", "?", "!", "<")):
                i += 1
            name, after = t.at(i), i + 1
            if i >= end or t.kind[i] != "name":
                i = (t.match[i] if t.at(i) in _OPENS else i) + 1
                continue
            while t.at(after) in ("?", "!"):
                after += 1
            if t.at(after) == "<":
                after = self.behind_types(after)
            if t.at(after) == "(":
                i = self.function(after, end, scope, first, "method", name)
                continue
            last = self.end_of(i, end)
            own = self.symbol("variable", scope, name, first, last)
            self.decorated(first, own)
            self.calls(after, last + 1, scope)
            i = last + 1

    def decorators(self, i: int) -> int:
        while self.t.at(i) == "@" and i + 1 < len(self.t) and self.t.kind[i + 1] == "name":
            target, i = self.dotted(i + 1)
            self.held.append((i, target))
            if self.t.at(i) == "(":
                i = self.t.match[i] + 1
        return i

    def block(self, i: int, end: int, scope: str, top: bool) -> None:
        t = self.t
        while i < end:
            first = i
            i = self.decorators(i)
            while i < end and t.at(i) in _MODIFIERS and i + 1 < end and (t.kind[i + 1] == "name" or t.at(i + 1) == "@"):
                i = self.decorators(i + 1)
            word = t.at(i)
            named = i + 1 < end and t.kind[i + 1] == "name"
            if word == "import" and t.at(i + 1) not in ("(", "."):
                self.imports(i, end, scope)
                i = self.end_of(i, end) + 1
            elif word in ("class", "interface", "enum") and named:
                i = self.type_body(i + 1, end, scope, first, word)
            elif word == "const" and t.at(i + 1) == "enum" and i + 2 < end and t.kind[i + 2] == "name":
                i = self.type_body(i + 2, end, scope, first, "enum")
            elif word == "function" and (named or t.at(i + 1) == "*"):
                at = i + 1 + (t.at(i + 1) == "*")
                params = self.behind_types(at + 1) if t.at(at + 1) == "<" else at + 1
                i = self.function(params, end, scope, first, "function", t.at(at)) if t.at(params) == "(" else params
            elif word in ("const", "let", "var") and named:
                i = self.variable(i + 1, end, scope, first, top)
            elif word in _OPENS and word == "{":
                self.block(i + 1, min(t.match[i], end), scope, top=False)
                i = t.match[i] + 1
            else:
                last = self.end_of(i, end)
                self.statement(i, last + 1, scope)
                i = max(last, i) + 1
            self.held = []

    def statement(self, i: int, end: int, scope: str) -> None:
        """Calls of a statement; blocks in it are read as blocks."""
        at = i
        for k in range(i, end):
            if k >= at and self.t.at(k) == "{" and self.t.at(k - 1) in (")", "=>", "else", "try", "finally", "do"):
                self.calls(at, k, scope)
                self.block(k + 1, min(self.t.match[k], end), scope, top=False)
                at = self.t.match[k] + 1
        self.calls(at, end, scope)

    def variable(self, i: int, end: int, scope: str, first: int, top: bool) -> int:
        t, name, last = self.t, self.t.at(i), self.end_of(i, end)
        value = next((k for k in range(i + 1, last + 1) if t.at(k) == "="), None)
        at = value + 1 if value is not None else None
        if at is not None and t.at(at) == "async":
            at += 1
        if at is not None and t.at(at) == "<":
            at = self.behind_types(at)
        arrow = at is not None and (t.at(at) == "function" or t.at(at) == "(" and "=>" in (t.at(k) for k in range(min(t.match[at], last), min(last + 1, t.match[at] + 12))))
        if arrow:
            params = next((k for k in range(at, last + 1) if t.at(k) == "("), None)
            own = self.symbol("function", scope, name, first, last, self.signature(name, params) if params is not None else None)
            self.statement((t.match[params] + 1) if params is not None else at, last + 1, own)
        elif top:
            self.symbol("variable", scope, name, first, last)
            self.statement(i + 1, last + 1, scope)
        else:
            self.statement(i + 1, last + 1, scope)
        return last + 1

    held: list[tuple[int, str]] = []


def parse_typescript(path: str, text: str) -> Parsed:
    """Never raises on bad source."""
    try:
        reader = _Reader(path, text)
        reader.held = []
        own = reader.symbol("file", None, path.rpartition("/")[2], 0, 0)
        reader.block(0, len(reader.t), own, top=True)
        return reader.out
    except (RecursionError, IndexError, KeyError):
        out = Parsed(path, count_lines(text))
        out.symbols = [{
            "symbol_seq": 0, "kind": "file", "name": path.rpartition("/")[2], "qualified_name": module_name(path), "start_line": 1, "end_line": max(out.n_lines, 1),
            "signature": None, "docstring": None, "parent_qualified_name": None,
        }]
        return out
