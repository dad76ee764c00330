"""What a text must hold for a pattern to match: literals read off the parsed pattern, so that most texts are passed over without matching."""

from __future__ import annotations

from re import _constants as C
from re import _parser

#: Literals that may stand for one pattern, and the least length of each; beyond that a pattern has no gate.
MOST, SHORTEST = 12, 2


def _joined(left: list[str], right: list[str]) -> list[str] | None:
    out = [a + b for a in left for b in right]
    return out if len(out) <= MOST else None


def _better(a: list[str] | None, b: list[str] | None) -> list[str] | None:
    """Of two sets of literals the one whose shortest is longer, then the smaller one."""
    rank = lambda s: (min(map(len, s)), -len(s)) if s else (-1, 0)
    return a if rank(a) >= rank(b) else b


def _exact(op, value) -> list[str] | None:
    """All texts that an item matches, if they are few."""
    if op is C.LITERAL:
        return [chr(value)]
    if op is C.IN and all(o is C.LITERAL for o, _ in value) and len(value) <= 4:
        return [chr(v) for _, v in value]
    if op is C.SUBPATTERN:
        return _whole(value[-1])
    if op is C.BRANCH:
        each = [_whole(v) for v in value[1]]
        out = [x for e in each if e for x in e]
        return out if all(each) and len(out) <= MOST else None
    if op is C.MAX_REPEAT and value[0] == value[1] == 1:
        return _whole(value[2])
    return None


def _whole(items) -> list[str] | None:
    out = [""]
    for op, value in items:
        exact = _exact(op, value)
        out = _joined(out, exact) if exact is not None and out is not None else None
        if out is None:
            return None
    return out


def _within(items) -> list[str] | None:
    """The best set of literals of which each match of the items holds one."""
    best, run = None, [""]
    for op, value in items:
        exact = _exact(op, value)
        longer = _joined(run, exact) if exact is not None else None
        if longer is not None:
            run = longer
            continue
        best, run = _better(best, run if all(run) else None), exact if exact is not None else [""]
        inner = None
        if op is C.SUBPATTERN:
            inner = _within(value[-1])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and value[0] >= 1:
            inner = _within(value[2])
        elif op is C.BRANCH:
            each = [_within(v) for v in value[1]]
            inner = [x for e in each for x in e] if all(each) and sum(map(len, each)) <= MOST else None
        best = _better(best, inner)
    return _better(best, run if all(run) else None)


def required(pattern: str) -> tuple[list[str], bool]:
    """(literals, folded): each match holds one of the literals; folded: only after folding case, and they are in lower case.

    No literals if the pattern has no such set or can't be read.
    """
    try:
        found = _within(_parser.parse(pattern))
    except Exception as e:  # patterns of another dialect
        if type(e).__name__ not in ("error", "PatternError"):
            raise
        return [], False
    folded = "(?i" in pattern
    found = sorted({x.lower() if folded else x for x in found or []})
    return (found, folded) if found and min(map(len, found)) >= SHORTEST and all(x.isascii() for x in found) else ([], folded)


def gate(pattern: str, plain: str, low: str, quoted) -> str:
    """A SQL condition on columns plain and low (its case folded) that holds wherever the pattern matches; quoted makes a literal."""
    found, folded = required(pattern)
    return " OR ".join(f"contains({low if folded else plain}, {quoted(x)})" for x in found) or "true"
