"""Histories, containment and total orders on rows written out or counted by brute force."""

import datetime
import random

from pyspark.sql import functions as F

from riskloom.operators import compare, contain, history, ordinals

COMMIT = "repo int, commit string, parents array<string>, tree string, author string, author_time timestamp"
DAY = lambda n: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=n)


def _repository(spark):
    """a - b - d(merge of b and c) - e, c beside b; c's clock is behind; config.js with a secret comes in a, goes in e; x.js comes in c and stands at two paths."""
    commits = [(1, "a", [], "ta", "ann", DAY(5)), (1, "b", ["a"], "tb", "bob", DAY(9)), (1, "c", ["a"], "tc", "cy", DAY(1)), (1, "d", ["b", "c"], "td", "bob", DAY(9)), (1, "e", ["d"], "te", "bob", DAY(9)), (2, "z", None, "ta", "zoe", None), (2, "y", ["gone", "y"], "tz", "zoe", DAY(0))]
    trees = [("ta", "config.js", "blob", "s1"), ("tb", "config.js", "blob", "s1"), ("tb", "b.py", "blob", "p1"), ("tc", "config.js", "blob", "s1"), ("tc", "lib", "tree", "l1"), ("l1", "x.js", "blob", "x1"), ("l1", "y.js", "blob", "x1"), ("td", "config.js", "blob", "s1"), ("td", "b.py", "blob", "p1"), ("td", "lib", "tree", "l1"), ("te", "config.js", "blob", "s2"), ("te", "b.py", "blob", "p1"), ("te", "lib", "tree", "l1")]
    trees = [(1, *t) for t in trees] + [(2, "ta", "config.js", "blob", "s1"), (2, "tz", "k", "blob", "s1")]
    return spark.createDataFrame(commits, COMMIT), spark.createDataFrame(trees, "repo int, tree string, name string, kind string, object string")


def test_places_grow_from_parents_to_children(spark):
    commits, _ = _repository(spark)
    place = {(r["repo"], r["commit"]): r["place"] for r in history.ordered(commits).collect()}
    at = lambda n: int(DAY(n).replace(tzinfo=datetime.timezone.utc).timestamp())
    assert place == {(1, "a"): at(5), (1, "b"): at(9), (1, "c"): at(5) + 1, (1, "d"): at(9) + 1, (1, "e"): at(9) + 2, (2, "z"): 0, (2, "y"): at(0)}


def test_places_of_long_chains_and_merges(spark):
    draw = random.Random(3)
    rows, want = [], {}
    for k in range(300):
        parents = [] if k == 0 else [k - 1] if draw.random() < 0.8 else draw.sample(range(k), min(k, 2))
        time = draw.randrange(50)
        want[k] = max([time, *(want[p] + 1 for p in parents)])
        rows.append((1, str(k), list(map(str, parents)), "t", "x", datetime.datetime.fromtimestamp(time, datetime.timezone.utc).replace(tzinfo=None)))
    made = {int(r["commit"]): r["place"] for r in history.ordered(spark.createDataFrame(rows, COMMIT)).collect()}
    assert made == want


def test_first_and_last_commit_of_a_blob(spark):
    commits, trees = _repository(spark)
    made = {(r["repo"], r["blob"]): (r["first_commit"], r["first_path"], r["last_commit"], r["paths"]) for r in history.blob_commits(commits, trees).collect()}
    assert made[1, "s1"] == ("a", "config.js", "e", 1)
    assert made[1, "x1"] == ("c", "lib/x.js", "c", 2)  # not the merge
    assert made[1, "p1"] == ("b", "b.py", "b", 1) and made[1, "s2"] == ("e", "config.js", "e", 1)
    assert made[2, "s1"] == ("z", "config.js", "y", 2)
    assert history.blob_commits(commits.where("false"), trees).count() == 0


def test_leaks_are_what_no_text_of_the_newest_tree_holds(spark):
    commits, trees = _repository(spark)
    key, other = "sk_live_" + "51H8xLmNoPqRsTuVwXyZ1234abcd", "sk_live_" + "zzH8xLmNoPqRsTuVwXyZ1234abcd"
    blobs = [(1, "s1", 50, f"const k = '{key}';"), (1, "s2", 50, "process.env.K"), (1, "x1", 50, f"// {other} in a comment"), (1, "lost", 9, f"{key}0 {other}"), (1, "p1", 4 << 20, key), (2, "s1", 50, key)]
    blobs = spark.createDataFrame(blobs, "repo int, blob string, size long, content string")
    assert {r["blob"] for r in history.readable(blobs).where("repo = 1").collect()} == {"s1", "s2", "x1", "lost"}
    found = [(1, "s1", "stripe-secret", 4, key), (1, "x1", "stripe-secret", 4, other), (1, "lost", "stripe-secret", 4, key + "0"), (2, "s1", "stripe-secret", 4, key)]
    found = spark.createDataFrame(found, "repo int, blob string, rule string, severity int, secret string")
    made = {(r["repo"], r["secret"]): (r["blob"], r["place"]) for r in history.leaks(found, blobs, commits, trees).collect()}
    assert made == {(1, key): ("s1", "git history @ a (ann, 2024-01-06)"), (1, key + "0"): ("lost", "git history")}


def test_standing_in_like_brute_force(spark):
    draw = random.Random(5)
    word = lambda n: "".join(draw.choice("abé\n") for _ in range(n))
    texts = [(k % 2, word(draw.randrange(400))) for k in range(60)] + [(0, None), (1, "")]
    needles = {word(n) for n in (1, 2, 3, 5, 9, 12, 17, 40) for _ in range(25)} | {t[11:44] for _, t in texts[:9]} | {"", texts[0][1]}
    rows = spark.createDataFrame([(g, n, 7) for n in sorted(needles) for g in (0, 1)] + [(0, None, 7)], "side int, needle string, piece int")
    frame = spark.createDataFrame(texts, "side int, text string")
    by_side = {(r["side"], r["needle"]) for r in contain.standing_in(rows, frame, ["side"]).collect()}
    assert by_side == {(g, n) for n in needles for g in (0, 1) if n and any(n in t for s, t in texts if t and s == g)}
    assert {r["needle"] for r in contain.standing_in(rows, frame).collect()} == {n for n in needles if n and any(n in t for _, t in texts if t)}
    nowhere = contain.standing_nowhere(rows.where("needle = '' or needle is null"), frame)
    assert nowhere.count() == 3 and contain.standing_in(rows.where("needle is null"), frame).count() == 0


def test_orders_over_many_partitions(spark):
    draw = random.Random(7)
    rows = [(k, draw.choice([None, None, None, k]), draw.randrange(3)) for k in draw.sample(range(100000), 3000)]
    frame = spark.createDataFrame(rows, "k int, v int, n int").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    runs = ordinals.runs(frame, F.col("k"))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    made = ordinals.carried(ordinals.running(runs, [F.col("k")], F.col("n"), "total"), [F.col("k")], {"last": F.col("v")}).orderBy("k").collect()
    assert len({r["run_"] for r in made}) > 1
    total, last = 0, None
    for r, (k, v, n) in zip(made, sorted(rows, key=lambda r: r[0]), strict=True):
        total, last = total + n, v if v is not None else last
        assert (r["k"], r["total"], r["last"]) == (k, total, last)
    made = [r["place"] for r in ordinals.placed(frame, F.desc("n"), F.asc("k")).orderBy(F.desc("n"), "k").collect()]
    assert made == list(range(1, 3001))
    assert ordinals.placed(frame.where("false"), F.asc("k")).count() == 0


def test_lines_of_a_diff(spark):
    text = ["diff --git a/x b/x", "--- a/x", "+++ b/x", "@@ -1,2 +10,3 @@ f", "+one", "-gone", "+two", "++++ three", "@@ -9 +40 @@", "+four", "--- a/y", "+++ /dev/null", "@@ -1 +0,0 @@", "-y", "+++ b/z", "@@ -0,0 +1 @@", "+z"]
    diff = spark.createDataFrame(list(enumerate(text)), "ord int, text string").repartition(5)
    new = spark.createDataFrame([("n",), ("n",)], "path string")
    made = {(r["path"], r["line"]) for r in compare.changed_lines(diff, new).collect()}
    assert made == {("x", 10), ("x", 11), ("x", 40), ("z", 1), ("n", 0)}
    names = spark.createDataFrame([("x",), ("",), (None,), ("n",)], "path string")
    assert {r["path"] for r in compare.changed_files(names, new).collect()} == {"x", "n"}
