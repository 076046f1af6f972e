"""Texts that a pattern matches, made from its syntax: for self tests and derived tables."""

from __future__ import annotations

import random
import re
import re._constants as op
import re._parser as parser

_LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
_WORD = _LETTERS + "_"
_CLASSES = {op.CATEGORY_DIGIT: "0123456789", op.CATEGORY_WORD: _WORD, op.CATEGORY_SPACE: " ", op.CATEGORY_NOT_SPACE: _WORD, op.CATEGORY_NOT_DIGIT: "ab", op.CATEGORY_NOT_WORD: "-"}


def _members(items: list) -> str:
    """ASCII letters of a class, alphanumeric ones if it has any."""
    inside = set()
    for kind, arg in items:
        if kind is op.LITERAL:
            inside.add(chr(arg))
        elif kind is op.RANGE:
            inside |= {chr(c) for c in range(arg[0], min(arg[1], 126) + 1)}
        elif kind is op.CATEGORY:
            inside |= set(_CLASSES[arg])
    if items[0][0] is op.NEGATE:
        inside = {chr(c) for c in range(33, 127)} - inside
    return "".join(sorted(inside & set(_LETTERS) or inside))


def example(pattern: str, seed: int = 0) -> str:
    """A text that ``pattern`` matches, the same for the same seed; repeats are as short as allowed, or a few longer."""
    rng = random.Random(f"{seed} {pattern}")

    def of(items: object, edge: str) -> str:
        out = []
        for kind, arg in items:
            if kind is op.LITERAL:
                out.append(chr(arg))
            elif kind is op.NOT_LITERAL:
                out.append("a" if arg != ord("a") else "b")
            elif kind is op.ANY:
                out.append("a")
            elif kind is op.IN:
                out.append(rng.choice(_members(arg)))
            elif kind in (op.MAX_REPEAT, op.MIN_REPEAT):
                least, most, inner = arg
                n = min(most, max(least, 1) + rng.randrange(3))
                out += [of(inner, edge) for _ in range(n)]
            elif kind is op.SUBPATTERN:
                out.append(of(arg[3], edge))
            elif kind is op.BRANCH:
                out.append(of(rng.choice(arg[1]), edge))
            elif kind is op.AT:
                out.append(edge if arg is op.AT_BOUNDARY else "")
            else:
                raise ValueError(f"no example for {kind}")
        return "".join(out)

    tree = parser.parse(pattern)
    text = of(tree, "")
    return text if re.search(pattern, text) else of(tree, " ")
