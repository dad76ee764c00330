"""User input followed through a code base: within functions by file, across files by a fixpoint of Spark joins."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..durable import checkpointed, scratch_tables, shuffled_joins
from ..functions import taint_patterns as T
from ..functions.code_patterns import SOURCES
from ..shipping import ship
from .groups import dealt, starts, whole

_A = re.ASCII
_source, _assign, _call, _seed = (re.compile(p.replace(r"\s", "[\\t\\n\\f\\r ]") if p is SOURCES else p, _A) for p in (SOURCES, T.ASSIGN, T.CALL, T.SEED_CALL))
_typed, _encoded, _cs_name, _cs_action, _cs_method = (re.compile(p, _A) for p in (T.TYPED, T.ENCODED, T.CS_NAME, T.CS_ACTION, T.CS_METHOD))
_boundary = {k: re.compile(p, _A) for k, p in T.BOUNDARY.items()}
_definition = {k: re.compile(p, _A) for k, p in T.DEFINITION.items()}
_token = re.compile(r"[A-Za-z0-9_$]+")


def _arguments(text: str, at: int) -> str:
    """What stands between the parenthesis at `at` and its partner, or the end."""
    depth = 0
    for k in range(at, len(text)):
        depth += (text[k] == "(") - (text[k] == ")")
        if not depth:
            return text[at + 1 : k]
    return text[at + 1 :]


def parameters(line: str) -> list[str]:
    """Names of the parameters of a one-line C# method."""
    at = line.find("(")
    if at < 0 or line.count(")") == 0:
        return []
    parts, depth, names = [""], 0, []
    for c in _arguments(line, at):
        depth = max(0, depth + (c in "<([") - (c in ">)]"))
        if c == "," and not depth:
            parts.append("")
        else:
            parts[-1] += c
    for part in parts:
        words = re.sub(r"\[[^\]]*\]", " ", part).split("=")[0].split()
        if len(words) > 1 and _token.fullmatch(words[-1].lstrip("@")):
            names.append(words[-1].removeprefix("@"))
    return names


@dataclass
class _Scope:
    """Tainted names of a function: the line where their input entered, and those that are safe in HTML."""

    entered: dict[str, int] = field(default_factory=dict)
    safe: set[str] = field(default_factory=set)

    def held(self, text: str) -> list[str]:
        return [w for w in dict.fromkeys(_token.findall(text)) if w in self.entered] if self.entered else []

    def assign(self, name: str, value: str, line_no: int) -> None:
        held, direct = self.held(value), bool(_source.search(value))
        if not held and not direct:
            return
        if _typed.search(value):
            self.entered.pop(name, None)
            self.safe.discard(name)
            return
        known = [self.entered[w] for w in held if w != name]
        self.entered[name] = line_no if direct or not known else min(known)
        (self.safe.add if _encoded.search(value) else self.safe.discard)(name)


def follow(lines: list[str], end: str, callees: set[str]) -> tuple[list[tuple[bool, bool, int]], set[str]]:
    """Of each line whether input reaches it, whether only encoded, and where it entered; and the names called with input.

    A line is judged before its own assignment takes effect; a new function starts with nothing but the parameters
    that its callers, or an action attribute shortly above, taint.
    """
    scope, out, called, action = _Scope(), [], set(), -100
    boundary, definition = _boundary.get(end), _definition.get(end)
    for i, line in enumerate(lines):
        if boundary and boundary.search(line):
            scope = _Scope()
            m = definition.search(line) if definition else None
            if m and m[1] in callees:
                scope.entered[m[2]] = i + 1
            m = _cs_name.search(line) if end == ".cs" else None
            if m and m[1] in callees:
                scope.entered |= dict.fromkeys(parameters(line), i + 1)
        if end == ".cs":
            action = i if _cs_action.search(line) else action
            if _cs_method.search(line) and i - action <= T.ACTION_LINES:
                for name in parameters(line):
                    scope.entered.setdefault(name, i + 1)
        direct, held = bool(_source.search(line)), scope.held(line)
        entered = [scope.entered[w] for w in held] + [i + 1] * direct
        out.append((bool(entered), bool(held) and not direct and all(w in scope.safe for w in held), min(entered, default=0)))
        m = _assign.search(line)
        if m:
            scope.assign(m[1], m[2], i + 1)
        for m in _call.finditer(line):
            if m[1] not in T.KEYWORDS:
                inner = _arguments(line, m.end() - 1)
                if _source.search(inner) or scope.held(inner):
                    called.add(m[1])
    return out, called


def _ending(path: str) -> str:
    m = re.search(r"\.[A-Za-z0-9]+$", path)
    return m[0] if m else ""


def _values(column: pa.Array) -> list:
    return column.to_numpy(zero_copy_only=False).tolist()


def _definitions(end: str, lines: list[str]) -> set[tuple[str, str]]:
    """(name, what) that a file's lines define or call whatever reaches them, and whether they read input."""
    found = {("", "file")}
    own = _definition.get(end)
    for line in lines:
        if _source.search(line) or (end == ".cs" and _cs_action.search(line)):
            found.add(("", "source"))
        m = _seed.search(line)
        if m:
            found.add((m[1], "calls"))
        m = own.search(line) if own else None
        if m:
            found.add((m[1], "defines"))
        m = _cs_name.search(line) if end == ".cs" else None
        if m:
            found.add((m[1], "defines"))
    return found


def _files(batches):
    """Batches of whole files, and of each file its first line's row, its path's ending, its lines and the names that reach it; names come first."""
    for batch in whole(batches, "path"):
        at, names, lines = starts(batch.column("path")).tolist(), _values(batch.column("name")), _values(batch.column("line"))
        paths = batch.column("path").take(pa.array(at[:-1], pa.int64())).to_pylist()
        files = []
        for path, a, b in zip(paths, at[:-1], at[1:], strict=True):
            first = a
            while first < b and names[first] is not None:
                first += 1
            files.append((first, _ending(path), lines[first:b], set(names[a:first])))
        yield batch, files


def _named(batch: pa.RecordBatch, rows: list[int], found: list[tuple]) -> pa.RecordBatch:
    """(path, name, what), the path from the batch's rows."""
    name, what = zip(*found, strict=True) if found else ((), ())
    return pa.RecordBatch.from_pydict({"path": batch.column("path").take(pa.array(rows, pa.int64())), "name": pa.array(name, pa.string()), "what": pa.array(what, pa.string())})


def _about(batches):
    """What files define and call; of those that read input also the names called with it where no caller's input reaches the file."""
    for batch, files in _files(batches):
        rows, found = [], []
        for first, end, lines, _ in files:
            own = _definitions(end, lines)
            if ("", "source") in own:
                own |= {(name, "reaches") for name in follow(lines, end, set())[1]}
            found += own
            rows += [first] * len(own)
        yield _named(batch, rows, found)


def _called(batches):
    for batch, files in _files(batches):
        rows, found = [], []
        for first, end, lines, names in files:
            if lines:
                own = follow(lines, end, names)[1]
                found += [(name, "reaches") for name in own]
                rows += [first] * len(own)
        yield _named(batch, rows, found)


def _judged(batches):
    for batch, files in _files(batches):
        rows, out = [], []
        numbers = _values(batch.column("line_no").fill_null(0))
        for first, end, lines, names in files:
            out += [(t, s, numbers[first + o - 1] if o else 0) for t, s, o in follow(lines, end, names)[0]]
            rows += range(first, first + len(lines))
        if rows:
            rows = pa.array(rows, pa.int64())
            tainted, safe, origin = zip(*out, strict=True)
            yield pa.RecordBatch.from_pydict({"path": batch.column("path").take(rows), "line_no": batch.column("line_no").take(rows), "tainted": pa.array(tainted), "html_safe": pa.array(safe), "origin": pa.array(origin, pa.int32())})


#: Lines that a task follows.
LINES_A_TASK = 100_000


def taint(lines: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(path, line_no, tainted, html_safe, origin) of the lines of all files that input can reach; other lines have no row.

    A file takes part if it reads input or defines a function that is called with input. Names defined once in the
    code base carry input into their first parameter (in C# all of them). Rounds of joins go on until no name is new;
    a file's names travel with its rows, so nothing is gathered on the driver. A task takes files as a stream, one held at a
    time; a round follows the files alone that a new name reaches, as what others call is known.
    """
    spark = lines.sparkSession
    with shuffled_joins(spark), scratch_tables() as keep:
        files = lines.where("path is not null").select("path", F.col("line_no").cast("int").alias("line_no"), "line")
        count = files.count()
        ship(spark)

        def streamed(part: DataFrame, names: DataFrame | None, share: float, run: Callable, schema: str) -> DataFrame:
            rows = part.withColumn("name", F.lit(None).cast("string"))
            if names is not None:
                rows = rows.unionByName(names.select("path", F.lit(None).cast("int").alias("line_no"), F.lit(None).cast("string").alias("line"), "name"))
            return dealt(rows, "path", int(count * share), LINES_A_TASK, "line_no").mapInArrow(run, schema)

        named = "path string, name string, what string"
        about = checkpointed(streamed(files, None, 1, _about, named))
        n_files = about.where("what = 'file'").count()
        unique = about.where("what = 'defines'").groupBy("name").agg(F.count("*").alias("n"), F.first("path").alias("path")).where("n = 1").where(~F.col("name").isin(T.KEYWORDS)).select("name", "path")
        unique = checkpointed(unique)
        names = checkpointed(unique.join(about.where("what = 'calls'").select("name").distinct(), "name", "left_semi"))
        reading = about.where("what = 'source'").select("path")
        new, found = names, about.where("what = 'reaches'").join(names.select("path"), "path", "left_anti").select("name")
        for _ in range(most_rounds):
            changed = checkpointed(new.select("path").distinct())
            n_changed = changed.count()
            if n_changed:
                asked = names.join(changed, "path", "left_semi")
                own = streamed(files.join(changed, "path", "left_semi"), asked, n_changed / n_files, _called, named).select("name")
                found = own if found is None else found.unionByName(own)
            new = checkpointed(unique.join(found.distinct(), "name", "left_semi").join(names, "name", "left_anti"))
            if new.isEmpty():
                break
            names, found = checkpointed(names.unionByName(new)), None
        else:
            raise RuntimeError("names that carry input did not settle")
        part = checkpointed(reading.union(names.select("path")).distinct())
        share = part.count() / max(n_files, 1)
        return keep(streamed(files.join(part, "path", "left_semi"), names, share, _judged, "path string, line_no int, tainted boolean, html_safe boolean, origin int"))


def with_taint(findings: DataFrame, reached: DataFrame) -> DataFrame:
    """Findings with user_input, and the note where it enters; encoded values don't count for CWE-79, lookups by id always do."""
    rows = findings.join(reached, ["path", "line_no"], "left")
    given = F.coalesce("tainted", F.lit(False)) & ~((F.col("cwe") == "CWE-79") & F.coalesce("html_safe", F.lit(False)))
    rows = rows.withColumn("user_input", given | (F.col("rule") == "idor"))
    note = F.when(F.col("user_input") & (F.col("origin") > 0) & (F.col("origin") != F.col("line_no")), F.concat(F.lit("input enters at line "), F.col("origin").cast("string"))).otherwise("")
    return rows.withColumn("note", note).drop("tainted", "html_safe", "origin")

