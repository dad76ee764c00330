"""Queries that take many small groups as streams, held against the forms by joins and against what driver and tasks may do."""

import random

import pyarrow as pa
import pytest
from test_history import COMMIT, DAY

from riskloom.durable import shuffled_joins
from riskloom.operators import groups, history, repository, taint
from riskloom.plans import history_queries  # noqa: F401  registers its queries
from riskloom.plans.queries import QUERIES

TREES = "repo int, tree string, name string, kind string, object string"
HISTORY = ("repo", "blob", "first_commit", "first_path", "first_author", "first_time", "last_commit", "paths")


def _repositories(spark, count: int, odd: bool = False):
    draw = random.Random(11)
    commits, trees = [], []
    for repo in range(count):
        for k in range(draw.randrange(1, 30)):
            parents = draw.sample([f"c{p}" for p in range(k)], min(k, draw.choice([0, 1, 1, 1, 2, 3]))) + ["gone"] * draw.randrange(2)
            commits.append((repo, f"c{k}", parents or None, draw.choice([f"r{draw.randrange(k + 1)}", f"r{k}", None]), draw.choice("xyz"), DAY(draw.randrange(9)) if draw.random() < 0.9 else None))
            for name in draw.sample("abcde", 3):
                kind = draw.choice(["blob", "blob", "tree", "commit"])
                trees.append((repo, f"r{k}", name, kind, f"s{draw.randrange(6)}" if kind == "tree" else f"b{draw.randrange(12)}"))
        for k in range(6):
            trees += [(repo, f"s{k}", draw.choice("xy"), "blob", f"b{draw.randrange(12)}"), (repo, f"s{k}", "z", "tree", f"d{k % 2}")]
        trees += [(repo, "d0", "m", "blob", "b3"), (repo, "d1", "m", "blob", "b4")] * 2
    if odd:
        commits += [(0, "c0", ["c1"], "r0", "w", DAY(3)), (1, "u", ["v"], "r0", "w", DAY(3))]
        trees += [(1, "r0", "p/q", "blob", "b1"), (2, "s1", "z", "blob", "b7")]
        commits = [c for c in commits if c[0] or c[1] != "c1"]
    return spark.createDataFrame(commits, COMMIT), spark.createDataFrame(trees, TREES)


def _rows(frame, *columns):
    return sorted(map(str, frame.select(*columns).collect()))


def _text(odd: bool) -> str:
    return "odd ones" if odd else "plain"


@pytest.mark.parametrize("odd", [False, True], ids=_text)
def test_histories_in_tasks_equal_those_by_joins(spark, odd, monkeypatch):
    commits, trees = _repositories(spark, 25, odd)
    made = _rows(history._followed(commits, trees), *HISTORY, "touched", "newest")
    assert len(made) > 100
    monkeypatch.setattr(repository, "LARGEST_ROWS", 0)
    assert _rows(history._followed(commits, trees), *HISTORY, "touched", "newest") == made


def test_histories_of_small_repositories_take_few_jobs(spark):
    commits, trees = _repositories(spark, 5)
    spark.sparkContext.setJobGroup("few", "")
    assert history.blob_commits(commits, trees).count()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few")) < 20


def test_joins_of_histories_are_no_broadcasts_by_size(spark):
    one = spark.range(9)
    plan = lambda: one.join(spark.range(5), "id")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" in plan()
    with shuffled_joins(spark):
        assert "Broadcast" not in plan()
    assert "Broadcast" in plan()


@pytest.mark.parametrize("name", ["blob_commits", "history_leaks"])
def test_queries_of_histories_broadcast_nothing(spark, sf_dir, name):
    before = len(_plans(spark))
    assert QUERIES[name](spark, sf_dir).count()
    assert not [p for p in _plans(spark)[before:] if "BroadcastExchange" in p]


def test_secrets_of_blobs_are_searched_once(spark):
    commits, trees = _repositories(spark, 3)
    blobs = trees.where("kind = 'blob'").selectExpr("repo", "object as blob", "10L as size", "'none' as content").distinct()
    searched = spark.sparkContext.accumulator(0)

    def search(batches):
        for batch in batches:
            searched.add(len(batch))
            yield batch.assign(rule="r", severity=1, secret="key" + batch["blob"])

    found = blobs.select("repo", "blob").mapInPandas(search, "repo int, blob string, rule string, severity int, secret string")
    assert history.leaks(found, blobs, commits, trees).count() == blobs.count() == searched.value


def test_groups_of_a_stream_are_whole():
    draw = random.Random(2)
    keys = sorted(draw.choice("abcdefgh") + draw.choice(["", "é"]) for _ in range(200))
    for size in (1, 3, 50, 300):
        batches = pa.table({"k": keys, "n": range(200)}).to_batches(size)
        made = [(b.column("k").to_pylist(), b.column("n").to_pylist()) for b in groups.whole([*batches, batches[0].slice(0, 0)], "k")]
        assert [n for _, own in made for n in own] == list(range(200))
        assert all(a[0][-1] != b[0][0] for a, b in zip(made, made[1:], strict=False))
        for own, _ in made:
            at = groups.starts(pa.array(own)).tolist()
            assert [own[a] for a in at[:-1]] == sorted(set(own)) and at[-1] == len(own)


def _plans(spark) -> list[str]:
    found = spark._jsparkSession.sharedState().statusStore().executionsList()
    return [found.apply(k).physicalPlanDescription() for k in range(found.size())]


def test_input_through_many_files_equals_a_fixpoint_by_file(spark):
    draw = random.Random(4)
    files = {}
    for k in range(60):
        lines = ["const q = req.query.q;", f"f{draw.randrange(120)}(q);", f"f{draw.randrange(120)}(req.query.r);"] if k % 9 == 0 else []
        for j in range(draw.randrange(1, 3)):
            lines += [f"function f{draw.choice([2 * k + j, 2 * k + j, 2 * k + j, 7])}(a, b) {{", draw.choice(["  const c = parseInt(a);", "  const c = a + b;", "  const c = encodeURI(a);"]), f"  f{draw.randrange(120)}(c);", f"  f{draw.randrange(120)}(a);", "  eval(c);", "}"]
        files[f"src/m{k:02}.js"] = lines
    kinds = {path: taint._definitions(".js", lines) for path, lines in files.items()}
    defined = [(n, path) for path, own in kinds.items() for n, what in own if what == "defines"]
    unique = {n: path for n, path in defined if sum(n == m for m, _ in defined) == 1}
    carried: dict[str, set] = {}
    for n in {n for own in kinds.values() for n, what in own if what == "calls"} & set(unique):
        carried.setdefault(unique[n], set()).add(n)
    while True:
        part = {path for path, own in kinds.items() if ("", "source") in own} | set(carried)
        called = set().union(*(taint.follow(files[path], ".js", carried.get(path, set()))[1] for path in part))
        new = [n for n in called & set(unique) if n not in carried.get(unique[n], set())]
        if not new:
            break
        for n in new:
            carried.setdefault(unique[n], set()).add(n)
    want = {(path, k, *row) for path in part for k, row in enumerate(taint.follow(files[path], ".js", carried.get(path, set()))[0], 1)}
    frame = spark.createDataFrame([(path, k, line) for path, lines in files.items() for k, line in enumerate(lines, 1)], "path string, line_no int, line string").repartition(3)
    before = len(_plans(spark))
    made = taint.taint(frame).collect()
    assert len(carried) > 5 and {tuple(r) for r in made} == want and len(made) == len(want)
    assert not [p for p in _plans(spark)[before:] if "InPandas" in p]  # a call for each file would cost more than its lines
