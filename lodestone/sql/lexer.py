"""Tokens of the dialect, each with its line and column."""

from __future__ import annotations

import re
from dataclasses import dataclass

from lodestone.errors import ParseError

TOKEN = re.compile(
    r"""(?P<space>\s+)
      | (?P<number>\d+(?:\.\d*)*)
      | (?P<name>[A-Za-z_][A-Za-z0-9_.]*)
      | (?P<text>"(?:[^"\\]|\\.)*")
      | (?P<symbol>[=<>+\-*~?,;()])""",
    re.VERBOSE | re.DOTALL,
)


@dataclass(frozen=True)
class Token:
    kind: str  # name, number, text, symbol or end
    value: str
    line: int
    column: int

    def is_word(self, word: str) -> bool:
        return self.kind == "name" and self.value.upper() == word


def tokenize(sql: str) -> list[Token]:
    tokens, at, line, start = [], 0, 1, 0
    while at < len(sql):
        found = TOKEN.match(sql, at)
        if not found:
            what = "unterminated string" if sql[at] == '"' else f"unexpected character {sql[at]!r}"
            raise ParseError(what, line, at - start + 1)
        kind, raw = found.lastgroup, found.group()
        if kind != "space":
            value = re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), raw[1:-1], flags=re.DOTALL) if kind == "text" else raw
            tokens.append(Token(kind, value, line, at - start + 1))
        if breaks := raw.count("\n"):
            line, start = line + breaks, at + raw.rindex("\n") + 1
        at = found.end()
    tokens.append(Token("end", "", line, at - start + 1))
    return tokens
