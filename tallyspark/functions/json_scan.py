"""JSON values that begin inside a text."""

from __future__ import annotations

import re

_TOKEN = re.compile(
    r"[ \t\n\r]*(?:(?P<open>[{\[])|(?P<close>[}\]])|(?P<comma>,)|(?P<colon>:)"
    r"|(?P<string>\"(?:[^\"\\\x00-\x1f]|\\(?:[\"\\/bfnrt]|u[0-9a-fA-F]{4}))*+\")"
    r"|(?P<atom>-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null|NaN|-?Infinity))"
)


def read_value(text: str, at: int, known: dict[int, tuple[int, int] | None] | None = None) -> int | None:
    """Where the object or array that opens at `at` ends, read token by token; None if it does not parse.

    `known` is told of every object met on the way its end and its depth, or None if it does not parse: those that are
    open when reading fails fail with it.
    """
    known = {} if known is None else known
    held: list[list] = []  # [start, closing mark, depth] of what is open
    want, i = "value", at
    while found := _TOKEN.match(text, i):
        kind, i = found.lastgroup, found.end()
        mark = text[i - 1]
        if kind == "open" and want in ("value", "first value"):
            held.append([i - 1, "}" if mark == "{" else "]", 1])
            want = "first key" if mark == "{" else "first value"
        elif kind == "string" and want in ("key", "first key"):
            want = "colon"
        elif kind == "colon" and want == "colon":
            want = "value"
        elif kind == "comma" and want == "more":
            want = "key" if held[-1][1] == "}" else "value"
        elif kind in ("string", "atom") and want in ("value", "first value"):
            want = "more"
        elif kind == "close" and mark == held[-1][1] and want in ("more", "first key", "first value"):
            start, _, depth = held.pop()
            if mark == "}":
                known[start] = (i, depth)
            if not held:
                return i
            held[-1][2] = max(held[-1][2], depth + 1)
            want = "more"
        else:
            break
    known.update((start, None) for start, mark, _ in held if mark == "}")
    return None
