"""Reading s-expressions without recursion, however deep they nest."""

from __future__ import annotations

import re

_TOKEN = re.compile(r'\s+|;[^\n]*|(?P<open>\()|(?P<close>\))|(?P<string>"(?:[^"]|"")*")|\|(?P<quoted>[^|\\]*)\||(?P<atom>[^\s()";|]+)')
_LITERAL = re.compile(r"(?:\d+(?:\.\d+)?|#x[0-9a-fA-F]+|#b[01]+)\Z")


class ParseError(ValueError):
    """The text isn't a sequence of s-expressions, or not of commands."""


class Literal(str):
    """A numeral, decimal, bit vector or string, as it is written."""


def read_all(text: str) -> list:
    """All expressions of a text: lists, symbols (str, quotes removed), Literals."""
    top: list = []
    stack, at = [top], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ParseError(f"unexpected {text[at]!r} at offset {at}")
        at = m.end()
        kind = m.lastgroup
        if kind == "open":
            stack.append([])
        elif kind == "close":
            if len(stack) == 1:
                raise ParseError(f"unmatched ) at offset {at - 1}")
            done = stack.pop()
            stack[-1].append(done)
        elif kind == "string":
            stack[-1].append(Literal(m["string"]))
        elif kind == "quoted":
            stack[-1].append(m["quoted"])
        elif kind == "atom":
            stack[-1].append(Literal(m["atom"]) if _LITERAL.match(m["atom"]) else m["atom"])
    if len(stack) > 1:
        raise ParseError(f"{len(stack) - 1} unclosed (")
    return top


def show(term, most: int = 200) -> str:
    """An expression as text, cut after about ``most`` characters."""
    out, size, stack = [], 0, [term]
    while stack and size < most:
        x = stack.pop()
        if isinstance(x, list):
            stack.append(")")
            for k, y in enumerate(reversed(x)):
                stack.append(y)
                if k < len(x) - 1:
                    stack.append(" ")
            x = "("
        out.append(x)
        size += len(x)
    return "".join(out)
