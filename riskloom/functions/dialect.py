"""Regular expressions of the RE2 dialect in the dialect of Spark's rlike."""

from __future__ import annotations

_WORD = "[A-Za-z0-9_]"
_EDGE = f"(?:(?<!{_WORD})(?={_WORD})|(?<={_WORD})(?!{_WORD}))"
_SPACE = r"\t\n\f\r "


def to_java(pattern: str) -> str:
    """The same matches under java.util.regex.

    Word edges and white space are ASCII there, `.` stops at line feeds only, `$` is the end of the text, case is
    folded beyond ASCII, and `[` and `&&` inside a class are plain characters.
    """
    out, i, inside = ["(?d)"], 0, False
    while i < len(pattern):
        c, two = pattern[i], pattern[i : i + 2]
        if two in (r"\b", r"\s", r"\S") and not (two == r"\b" and inside):
            out.append({r"\b": _EDGE, r"\s": _SPACE if inside else f"[{_SPACE}]", r"\S": f"[^{_SPACE}]"}[two])
            i += 2
        elif c == "\\":
            out.append(two)
            i += 2
        elif inside:
            out.append(r"\[" if c == "[" else r"&\&" if two == "&&" else c)
            inside = c != "]"
            i += 2 if two == "&&" else 1
        elif c == "[":
            stop = 2 if pattern[i + 1] == "^" else 1
            out.append(pattern[i : i + stop])
            i += stop
            if pattern[i] == "]":
                out.append(r"\]")
                i += 1
            inside = True
        elif c == "$":
            out.append(r"\z")
            i += 1
        elif pattern.startswith(("(?i)", "(?i:"), i):
            out.append("(?iu" + pattern[i + 3])
            i += 4
        else:
            out.append(c)
            i += 1
    return "".join(out)
