"""Histories of repositories of bounded size, each followed whole in a task; history.py joins what is larger."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .groups import dealt, starts, whole

#: Rows of commits and trees up to which a repository is followed in a task, and rows that a task gets of all its repositories.
LARGEST_ROWS, ROWS_A_TASK = 100_000, 250_000
#: Changed paths that are remembered for pairs of trees, and folders within folders.
REMEMBERED, DEEPEST = 500_000, 200
_NOTHING: dict = {}


class Odd(Exception):
    """What this module leaves to the joins: a commit told twice, an entry told in two ways, a name with a slash, a circle."""


def _place(commits: dict, at: list) -> dict:
    """See history.ordered()."""
    place: dict = {}
    most = 1 + sum(len(parents) for _, parents in commits.values())
    for start in commits:
        ahead = [start]
        while ahead:
            commit = ahead[-1]
            if commit in place:
                ahead.pop()
                continue
            row, parents = commits[commit]
            waits = [p for p in parents if p not in place]
            if waits:
                ahead += waits
                if len(ahead) > most:
                    raise Odd
            else:
                place[commit] = max([at[row], *(place[p] + 1 for p in parents)])
                ahead.pop()
    return place


class _Trees:
    """Trees of a repository as {tree: {name: (kind, object)}}, and what changes from one to another."""

    def __init__(self, trees: dict):
        self.trees, self.known, self.size = trees, {}, 0

    def changes(self, old, new, depth: int = 0) -> list[tuple]:
        """(path, before, after) of blobs that come or go; a tree of None has no entry."""
        made = self.known.get((old, new))
        if made is not None:
            return made
        if depth > DEEPEST:
            raise Odd
        was, now, made = self.trees.get(old, _NOTHING), self.trees.get(new, _NOTHING), []
        pairs = [(name, o, n) for name, o in was.items() if o != (n := now.get(name))] + [(name, None, n) for name, n in now.items() if name not in was]
        for name, o, n in pairs:
            (old_kind, o), (new_kind, n) = o or (None, None), n or (None, None)
            before, after = o if old_kind == "blob" else None, n if new_kind == "blob" else None
            if before is not None or after is not None:
                made.append((name, before, after))
            o, n = o if old_kind == "tree" else None, n if new_kind == "tree" else None
            if o is not None or n is not None:
                made += [(f"{name}/{path}", before, after) for path, before, after in self.changes(o, n, depth + 1)]
        self.size += len(made) + 1
        if self.size > REMEMBERED:
            self.known, self.size = {}, 0
        self.known[old, new] = made
        return made


def _follow(commits: dict, tree: list, trees: _Trees, place: dict):
    """Of each blob the first time that a commit brings it, the last one that it is touched, as (place, commit, path), and its paths."""
    first, last, paths = {}, {}, {}
    for commit, (row, parents) in commits.items():
        own = tree[row]
        if len(parents) < 2:
            before = tree[commits[parents[0]][0]] if parents else None
            made = [] if own == before else [(path, after, (gone,)) for path, gone, after in trees.changes(before, own)]
        else:  # what none of the parents has at the path
            sides: dict = {}
            for parent in parents:
                before = tree[commits[parent][0]]
                for path, gone, after in trees.changes(before, own) if before != own else ():
                    sides.setdefault(path, (after, []))[1].append(gone)
            made = [(path, after, gone) for path, (after, gone) in sides.items() if len(gone) == len(parents)]
        here = place[commit]
        for path, after, gone in made:
            at = (here, commit, path)
            if after is not None:
                if after not in first or at < first[after]:
                    first[after] = at
                paths.setdefault(after, set()).add(path)
                if after not in last or at > last[after]:
                    last[after] = at
            for blob in gone:
                if blob is not None and (blob not in last or at > last[blob]):
                    last[blob] = at
    return first, last, paths


def _repository(a: int, b: int, of: dict[str, list]) -> list[tuple]:
    """(blob, row of the first commit, first path, last commit, paths, whether a commit touches it, whether the newest tree has it) of rows a to b."""
    is_commit, key, name, kind, thing, parents = (of[c] for c in ("is_commit", "id", "name", "kind", "object", "parents"))
    commits, trees = {}, {}
    for row in range(a, b):
        if is_commit[row]:
            if key[row] is None or key[row] in commits:
                raise Odd
            commits[key[row]] = (row, parents[row])
        else:
            if name[row] is None or "/" in name[row]:
                raise Odd
            entry = (kind[row], thing[row])
            tree = trees.get(key[row])
            if tree is None:
                trees[key[row]] = {name[row]: entry}
            elif tree.setdefault(name[row], entry) != entry:
                raise Odd
    commits = {c: (row, [p for p in dict.fromkeys(all_) if p != c and p in commits] if all_ else ()) for c, (row, all_) in commits.items()}
    if not commits:
        return []
    trees.pop(None, None)
    place, trees = _place(commits, of["at"]), _Trees(trees)
    first, last, paths = _follow(commits, name, trees, place)  # a commit's tree stands in the column of names
    newest = max(commits, key=lambda c: (place[c], c))
    there = {after for _, _, after in trees.changes(None, name[commits[newest][0]]) if after is not None}
    out = []
    for blob, at in last.items():
        begun = first.get(blob)
        out.append((blob, commits[begun[1]][0] if begun else None, begun[2] if begun else None, at[1], len(paths.get(blob, ())), True, blob in there))
    return out + [(blob, None, None, None, None, False, True) for blob in there if blob not in last]


def _values(column: pa.Array) -> list:
    return column.to_numpy(zero_copy_only=False).tolist()


def _lists(column: pa.Array) -> list[list]:
    at, values = column.offsets.to_numpy().tolist(), _values(column.values)
    return [values[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def _followed(batches):
    for batch in whole(batches, "repo"):
        of = {c: _values(batch.column(c)) for c in ("is_commit", "id", "name", "kind", "object")} | {"at": _values(batch.column("at").fill_null(0)), "parents": _lists(batch.column("parents"))}
        at = starts(batch.column("repo")).tolist()
        found, repos = [], []
        for a, b in zip(at[:-1], at[1:], strict=True):
            try:
                own = _repository(a, b, of)
            except Odd:
                own = [(None, None, None, None, None, False, False)]
            found += own
            repos += [a] * len(own)
        if not found:
            continue
        blob, row, path, last, paths, touched, newest = zip(*found, strict=True)
        row = pa.array(row, pa.int64())
        columns = {"repo": batch.column("repo").take(pa.array(repos, pa.int64())), "blob": pa.array(blob, pa.string()), "first_commit": batch.column("id").take(row), "first_path": pa.array(path, pa.string()), "first_author": batch.column("author").take(row), "first_time": batch.column("author_time").take(row)}
        yield pa.RecordBatch.from_pydict(columns | {"last_commit": pa.array(last, pa.string()), "paths": pa.array(paths, pa.int64()), "touched": pa.array(touched, pa.bool_()), "newest": pa.array(newest, pa.bool_())})


def followed(commits: DataFrame, trees: DataFrame, at: Column, count: int) -> DataFrame:
    """(repo, blob, first_commit, first_path, first_author, first_time, last_commit, paths, touched, newest) of commits and trees, in all `count` rows, of
    repositories that a task can hold. touched: a commit brings the blob or takes it away; newest: the newest tree has it. A repository that is Odd has one row, without a blob. at: a commit's time.
    """
    ship(commits.sparkSession)
    none = lambda kind: F.lit(None).cast(kind)
    kinds = {c: commits.schema[c].dataType.simpleString() for c in ("repo", "author", "author_time")}
    rows = commits.select("repo", F.lit(True).alias("is_commit"), F.col("commit").alias("id"), F.col("tree").alias("name"), none("string").alias("kind"), none("string").alias("object"), "parents", at.alias("at"), "author", "author_time")
    rows = rows.unionByName(trees.select("repo", F.lit(False).alias("is_commit"), F.col("tree").alias("id"), "name", "kind", "object", none("array<string>").alias("parents"), none("bigint").alias("at"), none(kinds["author"]).alias("author"), none(kinds["author_time"]).alias("author_time")))
    schema = f"repo {kinds['repo']}, blob string, first_commit string, first_path string, first_author {kinds['author']}, first_time {kinds['author_time']}, last_commit string, paths bigint, touched boolean, newest boolean"
    return dealt(rows.where("repo is not null"), "repo", count, ROWS_A_TASK).mapInArrow(_followed, schema)
