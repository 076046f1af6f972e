"""RE2 patterns in the syntax of Java, and the literal that a match must hold."""

from __future__ import annotations

import re
import re._constants as op
import re._parser as parser
from collections.abc import Iterable

_WORD = "0-9A-Za-z_"
_BOUND = rf"(?:(?<![{_WORD}])(?=[{_WORD}])|(?<=[{_WORD}])(?![{_WORD}]))"
_WHITE = r"\t\n\f\r "


def to_java(pattern: str) -> str:
    """ASCII word bounds and white space, ``.`` and ``$`` as in RE2, Unicode folding, literal ``[`` in classes."""
    out, i, first, in_class, dot_all = [], 0, 0, False, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            d = pattern[i + 1]
            if d == "b" and not in_class:
                out.append(_bound(pattern, i))
            elif d == "s":
                out.append(_WHITE if in_class else f"[{_WHITE}]")
            elif d == "S" and not in_class:
                out.append(f"[^{_WHITE}]")
            else:
                out.append(c + d)
            i += 2
            continue
        if in_class:
            if c == "[":
                out.append("\\[")
            elif c == "]" and i > first:
                in_class = False
                out.append(c)
            elif c == "&":
                out.append("\\&")
            else:
                out.append(c)
        elif c == "[":
            in_class = True
            first = i + 1 + pattern.startswith("^", i + 1)  # a bracket here is a member
            out.append(c)
        elif c == "(" and (m := re.match(r"\(\?([is]+)([):])", pattern[i:])):
            dot_all |= "s" in m[1]
            out.append(f"(?{m[1].replace('i', 'iu')}{m[2]}")
            i += len(m[0])
            continue
        elif c == ".":
            out.append("." if dot_all else "[^\\n]")
        elif c == "$":
            out.append("\\z")
        else:
            out.append(c)
        i += 1
    return "".join(out)


def _bound(pattern: str, i: int) -> str:
    """A word bound; where a word character is sure to stand on one side, a look at the other side will do."""
    if re.match(r"[0-9A-Za-z_]", pattern[i + 2 : i + 3]) and not re.match(r"[?*{|]", pattern[i + 3 : i + 4]) and "(?i" not in pattern:
        return f"(?<![{_WORD}])"
    if re.search(r"\[[0-9A-Za-z_-]*[0-9A-Za-z_]\](?:\{[1-9]\d*(?:,\d*)?\}|\+)?\Z", pattern[:i]) and not re.search(r"\[[^\]]*[^0-9A-Za-z]-[^\]]*\][^\]]*\Z|\[-[^\]]*\][^\]]*\Z", pattern[:i]) and "(?i" not in pattern:
        return f"(?![{_WORD}])"
    return _BOUND


def leading(pattern: str, group: int) -> str | None:
    """The pattern with all that stands before a group captured as its first group; None where that can't be done.

    The group must stand at the top level of a pattern without alternatives there. Its length gives the group's place.
    """
    flags = m[0] if (m := re.match(r"\(\?[a-z]+\)", pattern)) else ""
    depth = count = 0
    at, in_class, i = None, False, len(flags)
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 2
            continue
        if in_class:
            in_class = c != "]" or i == first
        elif c == "[":
            in_class, first = True, i + 1 + pattern.startswith("^", i + 1)
        elif c == "(":
            if not pattern.startswith("(?", i) or pattern.startswith("(?P<", i):
                count += 1
                if count == group:
                    at = i if depth == 0 else None
            depth += 1
        elif c == ")":
            depth -= 1
        elif c == "|" and depth == 0:
            return None
        i += 1
    return f"{flags}({pattern[len(flags) : at]}){pattern[at:]}" if at is not None and group else None


def anchors(pattern: str, least: int = 3) -> tuple[str, ...]:
    """Literals (lower case, ``least`` letters at least) of which every match holds at least one; none if there are no such.

    Alternatives and small classes give several. They are to be looked for in a text folded by ``lower``, with the long s
    as s: under case folding that letter and the Kelvin sign stand for s and k.
    """
    tree = parser.parse(pattern.encode().decode("latin-1"))
    good = lambda c: c < 128

    def better(a: set[str], b: set[str]) -> set[str]:
        def rank(x: set[str]) -> tuple[bool, int, int]:
            short = min(map(len, x), default=0)
            return short >= least, -len(x) if short >= least else 0, short

        return max(a, b, key=rank)

    def heads(items: object) -> set[str]:
        """Literals with which a sequence begins."""
        runs = {""}
        for kind, arg in items:
            if kind is not op.LITERAL or not good(arg):
                break
            runs = {r + chr(arg).lower() for r in runs}
        return runs

    def best(items: object) -> set[str]:
        found, runs = set(), {""}
        for kind, arg in items:
            if kind is op.LITERAL and good(arg):
                options = {chr(arg).lower()}
            elif kind is op.IN and arg[0][0] is not op.NEGATE and all(k is op.LITERAL and good(c) for k, c in arg):
                options = {chr(c).lower() for _, c in arg}
            elif kind is op.AT:
                continue
            else:
                options = set()
            if options and len(runs) * len(options) <= 16:
                runs = {r + o for r in runs for o in options}
                found = better(found, runs)
                continue
            before, runs = runs, {""}
            if kind is op.SUBPATTERN and not arg[1]:
                found = better(found, best(arg[3]))
            elif kind is op.BRANCH:
                begun = {r + h for r in before for x in arg[1] for h in heads(x)}
                found = better(found, begun) if len(begun) <= 32 else found
                each = [best(x) for x in arg[1]]
                if all(min(map(len, e), default=0) >= least for e in each):
                    found = better(found, set().union(*each))
            elif kind is op.MAX_REPEAT and arg[0] >= 1:
                found = better(found, best(arg[2]))
        return found

    found = best(tree)
    return tuple(sorted(found)) if min(map(len, found), default=0) >= least else ()


def least_run(pattern: str) -> int:
    """Length of the longest run of ASCII letters and digits that every match holds for certain."""

    def plain(kind: object, arg: object) -> bool:
        if kind is op.LITERAL:
            return chr(arg).isascii() and chr(arg).isalnum()
        if kind is op.RANGE:
            return any(a <= chr(arg[0]) and chr(arg[1]) <= z for a, z in ("09", "AZ", "az"))
        if kind is op.CATEGORY:
            return arg is op.CATEGORY_DIGIT
        return kind is op.IN and all(plain(*x) for x in arg)

    def walk(items: object) -> int:
        best = run = 0
        for kind, arg in items:
            if plain(kind, arg):
                run += 1
            elif kind in (op.MAX_REPEAT, op.MIN_REPEAT) and len(arg[2]) == 1 and plain(*arg[2][0]):
                run += arg[0]
                if arg[0] != arg[1]:  # more may follow, of the same kind: the run goes on
                    best = max(best, run)
            elif kind is op.AT:
                continue
            else:
                best, run = max(best, run), 0
                if kind is op.SUBPATTERN and not arg[1]:
                    best = max(best, walk(arg[3]))
                elif kind is op.BRANCH:
                    best = max(best, min(map(walk, arg[1])))
                elif kind is op.MAX_REPEAT and arg[0] >= 1:
                    best = max(best, walk(arg[2]))
        return max(best, run)

    return walk(parser.parse(pattern.encode().decode("latin-1")))


def fragments(literals: Iterable[str], size: int = 3) -> dict[str, list[str]]:
    """Few short texts of which each literal holds one: each with the literals that it stands for, chosen greedily."""
    left, out = dict.fromkeys(sorted(set(literals))), {}
    while left:
        holds: dict[str, list[str]] = {}
        for x in left:
            for piece in {x[i : i + size] for i in range(max(1, len(x) - size + 1))}:
                holds.setdefault(piece, []).append(x)
        piece = max(holds, key=lambda p: (len(holds[p]), p))
        out[piece] = holds[piece]
        for x in holds[piece]:
            del left[x]
    return out
