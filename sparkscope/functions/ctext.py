"""Scanning of C text that regular expressions cannot do: layout-keeping blanks, balanced spans, definitions.

Plain Python over one text at a time, called in Arrow batches by
:mod:`sparkscope.operators.facts`; everything regular is done in Spark
expressions on what these return.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

_NOISE = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'", re.S)
_VISIBLE = re.compile(r"[^\n]")
_IDENTIFIER = re.compile(r"[A-Za-z_]\w*", re.A)
# Words that may stand between a signature and its body.
_QUALIFIERS = frozenset(("const", "noexcept", "override", "final", "volatile"))
_OPENERS, _CLOSERS = "([{<", ")]}>"


def blank_noise(text: str | None) -> str:
    """Comments and literals as blanks; line breaks and all other places stay."""
    return _NOISE.sub(lambda m: _VISIBLE.sub(" ", m[0]), text or "")


class Brackets:
    """Matching closers of one kind of bracket in a text, found in one pass."""

    def __init__(self, text: str, opener: str, closer: str):
        self.match: dict[int, int] = {}
        open_: list[int] = []
        for m in re.finditer("[" + re.escape(opener + closer) + "]", text):
            if m[0] == opener:
                open_.append(m.start())
            elif open_:
                self.match[open_.pop()] = m.start()

    def close(self, at: int) -> int:
        return self.match.get(at, -1)


class Source:
    """A C text with its blanks and brackets; cheap to ask for many functions."""

    def __init__(self, text: str | None):
        self.text = text or ""
        self.plain = blank_noise(self.text)
        self.round = Brackets(self.plain, "(", ")")
        self.curly = Brackets(self.plain, "{", "}")

    def _body_start(self, at: int) -> int:
        """Where the body opens after a signature's closer, past qualifiers and old-style declarations; -1 if none does."""
        plain, n = self.plain, len(self.plain)
        while at < n:
            rest = re.compile(r"\s*").match(plain, at).end()
            word = _IDENTIFIER.match(plain, rest)
            if rest < n and plain[rest] == "{":
                return rest
            if word and word[0] in _QUALIFIERS:
                at = word.end()
            elif word and word[0] in ("__attribute__", "throw"):
                opener = plain.find("(", word.end())
                closer = self.round.close(opener) if opener >= 0 else -1
                if closer < 0:
                    return -1
                at = closer + 1
            elif plain.startswith("->", rest):
                kind = re.compile(r"->\s*[\w:<>]+").match(plain, rest)
                if not kind:
                    return -1
                at = kind.end()
            else:
                declared = re.compile(r"[A-Za-z_][\w\s\*,\[\]]*;").match(plain, rest)
                if not declared:
                    return -1
                at = declared.end()
        return -1

    def definition(self, name: str) -> tuple[int, int, int, int] | None:
        """(line start, opener of the parameters, opener of the body, end) of the first definition of ``name``."""
        for m in re.finditer(rf"(?<![A-Za-z0-9_]){re.escape(name)}\s*\(", self.plain):
            line = self.text.rfind("\n", 0, m.start()) + 1
            closer = self.round.close(m.end() - 1)
            if ";" in self.text[line : m.start()] or closer < 0:
                continue
            body = self._body_start(closer + 1)
            end = self.curly.close(body) if body >= 0 else -1
            if end >= 0:
                return line, m.end() - 1, body, end + 1
        return None

    def excerpt(self, name: str, lead: int = 5, window: int = 50) -> str:
        """The definition with up to ``lead`` lines before it; else the lines around the first mention."""
        found = self.definition(name)
        if found:
            start = found[0]
            for _ in range(lead):
                start = self.text.rfind("\n", 0, max(0, start - 1)) + 1 if start else 0
            return self.text[start : found[3]]
        lines = self.text.splitlines()
        hit = next((i for i, line in enumerate(lines) if re.search(rf"\b{re.escape(name)}\b\s*\(", line)), None)
        return "" if hit is None else "\n".join(lines[max(0, hit - lead) : hit + window])

    def parameters(self, name: str) -> list[tuple[str, str]]:
        """(name, type) of a function's parameters, old-style declarations included."""
        found = self.definition(name)
        if not found:
            return []
        _, opener, body, _ = found
        closer = self.round.close(opener)
        out = []
        for part in split_top_level(self.plain[opener + 1 : closer]):
            part = re.sub(r"\s*=[^,]*$", "", part).strip()
            last = re.search(r"([A-Za-z_]\w*)\s*(?:\[.*\])?\s*$", part)
            if part in ("", "void", "...") or not last:
                continue
            out.append((last[1], part[: last.start(1)].strip() or "unknown"))
        if out and all(kind == "unknown" for _, kind in out):
            kinds = self._old_style(closer + 1, body)
            return [(n, kinds.get(n, "unknown")) for n, _ in out]
        return out

    def _old_style(self, start: int, end: int) -> dict[str, str]:
        kinds = {}
        for declaration in self.plain[start:end].split(";"):
            first, *more = split_top_level(declaration.strip()) or [""]
            last = _IDENTIFIER.findall(first)
            base = first[: first.rfind(last[-1])].strip() if last else ""
            if base:
                kinds[last[-1]] = base
                kinds |= {m.lstrip("* "): base + (" *" if m.startswith("*") else "") for m in more}
        return kinds

    def after_keyword(self, keyword: str) -> Iterator[str]:
        """What stands in the balanced brackets after each ``keyword``, trimmed."""
        for m in re.finditer(rf"\b{keyword}\s*\(", self.plain):
            closer = self.round.close(m.end() - 1)
            if closer >= 0:
                yield self.plain[m.end() : closer].strip()

    def blocks(self) -> list[tuple[str, int, int]]:
        """(name, start, end) of text blocks that look like functions, in order."""
        head = re.compile(r"^[\t ]*[A-Za-z_][\w\s\*:&<>\[\]]+\s+([A-Za-z_]\w*)\s*\([^;{]*\)\s*\{", re.M | re.A)
        raw = Brackets(self.text, "{", "}")
        return [(m[1], m.start(), raw.close(m.end() - 1) + 1) for m in head.finditer(self.text) if raw.close(m.end() - 1) >= 0]

    def switches(self) -> Iterator[tuple[str, str]]:
        """(expression, body) of each switch."""
        for m in re.finditer(r"\bswitch\s*\(", self.plain):
            closer = self.round.close(m.end() - 1)
            body = self.plain.find("{", closer) if closer >= 0 else -1
            end = self.curly.close(body) if body >= 0 else -1
            if end >= 0:
                yield self.plain[m.end() : closer].strip(), self.plain[body + 1 : end]


def split_top_level(text: str, blanks: str | None = None) -> list[str]:
    """Comma-separated parts outside brackets, trimmed (of ``blanks`` alone if given), without empty ones."""
    parts, depth, start = [], 0, 0
    for m in re.finditer(r"[()\[\]{}<>,]", text):
        if m[0] in _OPENERS:
            depth += 1
        elif m[0] in _CLOSERS:
            depth = max(0, depth - 1)
        elif depth == 0:
            parts.append(text[start : m.start()])
            start = m.end()
    return [p.strip(blanks) for p in [*parts, text[start:]] if p.strip(blanks)]


def holding_block(blocks: list[tuple[str, int, int]], at: int) -> str | None:
    """Name of the first block that holds a place; blocks are in order of their starts."""
    starts = [b[1] for b in blocks]
    return next((name for name, start, end in blocks[: bisect_right(starts, at)] if start <= at < end), None)


@lru_cache(maxsize=64)
def source(text: str) -> Source:
    return Source(text)


def call_places(text: str, name: str) -> list[int]:
    return [m.start() for m in re.finditer(rf"\b{re.escape(name)}\s*\(", text)]


def function_body(text: str, name: str) -> tuple[int, int] | None:
    """Bounds of the body of a function defined in a generated text."""
    m = re.search(rf"\b{re.escape(name)}\s*\([^;{{}}]*\)\s*\{{", text)
    end = Brackets(text, "{", "}").close(m.end() - 1) if m else -1
    return (m.end(), end) if end >= 0 else None


def first_at_or_after(places: list[int], at: int) -> int:
    i = bisect_left(places, at)
    return places[i] if i < len(places) else -1


def scan(text: str, fn: str) -> tuple[str, str, list[tuple[str, str]], list[str], list[str], list[tuple[str, str]]]:
    """(definition, its blanked form, parameters, conditions of if and of while, switches with bodies) of a function of a text."""
    file = source(text)
    code = file.excerpt(fn)
    part = Source(code)
    params = part.parameters(fn) or file.parameters(fn)
    return code, part.plain, params, list(part.after_keyword("if")), list(part.after_keyword("while")), list(part.switches())
