"""Tokens of the query language."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

_BIDI = re.compile("[‪-‮⁦-⁩]")
_TOKEN = re.compile(
    r"""(?P<space>\s+|--[^\n]*)
      | (?P<hash>sha256:[0-9a-fA-F]+)
      | (?P<string>"(?:[^"\\]|\\.)*")
      | (?P<age>\d+[dhm]\b)
      | (?P<number>-?\d+(?:\.\d+)?)
      | (?P<param>\$\w+)
      | (?P<op><=|>=|!=|->|[=<>(){}\[\],;|:.*])
      | (?P<word>[A-Za-z_]\w*(?:[:][a-z_]\w*(?=\s*(?:=|!=|<|>|IN\b|IS\b|NOT\b|CONTAINS\b|STARTS\b)))?)""",
    re.X,
)
_ESCAPES = {"n": "\n", "t": "\t", '"': '"', "\\": "\\"}


class QueryError(ValueError):
    """A query that can not be run, with its code."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    value: object = None

    def is_word(self, *names: str) -> bool:
        return self.kind == "word" and self.text.upper() in names


def lex(source: str) -> list[Token]:
    if _BIDI.search(source):
        raise QueryError("CAL-E001", "bidirectional control characters are refused")
    source, at, out = unicodedata.normalize("NFC", source), 0, []
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            raise QueryError("CAL-E001", f"unexpected character {source[at]!r} at {at}")
        at, kind, text = m.end(), m.lastgroup, m[0]
        if kind == "space":
            continue
        value: object = text
        if kind == "string":
            value = re.sub(r"\\(.)", lambda x: _ESCAPES.get(x[1], x[1]), text[1:-1])
        elif kind == "number":
            value = float(text)
        elif kind == "hash":
            value = text.removeprefix("sha256:").lower()
        out.append(Token(kind, text, value))
    out.append(Token("end", ""))
    return out
