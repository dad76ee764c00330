"""Source trees, policies and custom rules as inputs: folders are listed and files are read by tasks."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..durable import checkpointed, scratch_tables
from ..functions.code_patterns import ENDINGS
from ..functions.dialect import to_java
from ..functions.risk import SEVERITIES
from ..shipping import ship
from .stores import opened

#: Folders that are never read, the largest file, and the bytes in which a zero byte means binary.
SKIPPED = [".git", "node_modules", "vendor", ".venv", "venv", "__pycache__", "dist", "build", ".next", "target"]
LARGEST, SNIFFED = 2 * 1024 * 1024, 8000


def glob_pattern(glob: str) -> str:
    """A path glob as a regular expression; * and ? don't cross a slash."""
    out = ""
    for c in glob:
        out += {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c))
    return f"^{out}$"


def _fits(pattern: str):
    return lambda text: F.rlike(text, F.lit(to_java(pattern)))


def ignored(path: Column, patterns: list[str]) -> Column:
    """Whether a pattern names a relative path, its file, a folder above it or a run of its segments."""
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    out = F.lit(False)
    for p in (q.strip().rstrip("/") for q in patterns):
        if p and not p.startswith("#"):
            out = out | F.exists(above, _fits(glob_pattern(p))) | F.exists(parts, _fits(glob_pattern(p)))
            out = out | F.startswith(path, F.lit(p + "/")) | F.contains(path, F.lit(f"/{p}/"))
    return out


def _entries(root: str):
    """The entries of each folder of a batch: path below the root, name, bytes, and whether it is a folder. Folders behind links and what can't be read are left out."""

    def run(batches):
        from pyarrow import fs

        system, top = opened(root)
        local = isinstance(system, fs.LocalFileSystem)
        for batch in batches:
            for folder in batch.column("path").to_pylist():
                try:
                    found = system.get_file_info(fs.FileSelector("/".join(p for p in (top.rstrip("/"), folder) if p), allow_not_found=True))
                except OSError:
                    continue
                found = [f for f in found if f.type != fs.FileType.Directory or not (local and os.path.islink(f.path))]
                below = [f"{folder}/{f.base_name}" if folder else f.base_name for f in found]
                yield pa.RecordBatch.from_pydict({"path": pa.array(below, pa.string()), "name": pa.array([f.base_name for f in found], pa.string()), "size": pa.array([f.size or 0 for f in found], pa.int64()), "folder": pa.array([f.type == fs.FileType.Directory for f in found], pa.bool_())})

    return run


def listed_files(spark: SparkSession, root: str, patterns: list[str] = ()) -> DataFrame:
    """(path, size) of the files below root, hidden ones included, by tasks: each round lists the folders of one level.

    Skipped folders and ignored paths are not gone into; empty files and files over 2 MiB are left out. Nothing of the tree is on the driver.
    """
    ship(spark)
    with scratch_tables() as keep:
        folders, out = spark.createDataFrame([("",)], "path string"), None
        while True:
            found = folders.repartition("path").mapInArrow(_entries(root), "path string, name string, size bigint, folder boolean")
            found = checkpointed(found.where(~ignored(F.col("path"), list(patterns))))
            files = found.where((~F.col("folder")) & (F.col("size") > 0) & (F.col("size") <= LARGEST)).select("path", "size")
            out = files if out is None else out.unionByName(files)
            folders = found.where(F.col("folder") & ~F.col("name").isin(SKIPPED)).select("path")
            if folders.isEmpty():
                return keep(out)


def _contents(root: str):
    def run(batches):
        system, top = opened(root)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                try:
                    with system.open_input_stream(f"{top.rstrip('/')}/{path}") as stream:
                        data = stream.read(LARGEST + 1)
                except OSError:
                    continue
                if data and len(data) <= LARGEST and b"\0" not in data[:SNIFFED]:
                    yield pa.RecordBatch.from_pydict({"path": [path], "content": [data.decode("utf-8", "replace")]})

    return run


def source_files(spark: SparkSession, root: str, patterns: list[str] = ()) -> DataFrame:
    """(path, content) of the text files below root, which tasks list and read; a zero byte near the start means binary. Root is a URI that every task can open.

    Unreadable files are left out. Bytes that are no UTF-8 become the replacement character.
    """
    return listed_files(spark, root, patterns).select("path").repartition("path").mapInArrow(_contents(root), "path string, content string")


def read_ignore(root: str, name: str) -> list[str]:
    """The patterns of the ignore file `name` in root: trimmed, without a slash at the end; none if there is no such file. Blank lines and those that start with # don't count."""
    system, top = opened(root)
    try:
        with system.open_input_stream(f"{top.rstrip('/')}/{name}") as stream:
            text = stream.read().decode("utf-8", "replace")
    except (FileNotFoundError, OSError):
        return []
    lines = (line.strip() for line in text.split("\n"))
    return [line.removesuffix("/") for line in lines if line and not line.startswith("#")]


def source_lines(files: DataFrame) -> DataFrame:
    """(path, line_no, line), lines counted from 1; a file that ends with a line feed has an empty last line."""
    return files.select("path", F.posexplode(F.split("content", "\n", -1)).alias("at", "line")).select("path", (F.col("at") + 1).alias("line_no"), "line")


@dataclass
class Policy:
    disable: list[str] = field(default_factory=list)
    ignore: list[str] = field(default_factory=list)
    fail_on: str = ""


def parse_policy(text: str) -> Policy:
    """A flat policy file: `fail-on: level`, and the lists `disable` and `ignore`, in brackets or as items below."""
    policy, open_list = Policy(), None
    clean = lambda s: s.strip().strip("'\"")
    for raw in text.split("\n"):
        line = raw.split(" #")[0].strip()
        if not line or line.startswith("#"):
            continue
        if line.startswith("- ") and open_list is not None:
            open_list.append(clean(line[2:]))
            continue
        key, _, value = (p.strip() for p in line.partition(":"))
        open_list = {"disable": policy.disable, "ignore": policy.ignore}.get(key)
        if key == "fail-on":
            policy.fail_on = clean(value)
        elif open_list is not None and value.startswith("["):
            open_list += [clean(v) for v in value.strip("[]").split(",") if clean(v)]
    return policy


def parse_rules(text: str) -> list[tuple]:
    """Custom code rules as rows of CODE_RULES, ids with `custom:` before them; without an id or a valid pattern a rule is dropped."""
    items: list[dict[str, str]] = []
    for raw in text.split("\n"):
        line = raw.strip()
        if line.startswith("- "):
            items.append({})
            line = line[2:]
        key, colon, value = line.partition(":")
        if items and colon and not line.startswith("#"):
            items[-1][key.strip()] = value.strip().strip("'\"") if value.strip()[:1] in "'\"" else value.strip()
    rules = []
    for item in items:
        try:
            re.compile(item.get("pattern", "("))
        except re.error:
            continue
        spoken = [w for w in re.split(r"[\s,\[\]]+", item.get("langs", "")) if w in ENDINGS] or ["js", "py", "ruby", "php", "go"]
        level = item.get("severity", "MEDIUM").upper()
        if item.get("id"):
            rules.append((f"custom:{item['id']}", level if level in SEVERITIES else "MEDIUM", item.get("cwe", ""), " ".join(spoken), item["pattern"]))
    return rules
