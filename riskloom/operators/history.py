"""A repository's history as tables: commits(repo, commit, parents, tree, author_time), trees(repo, tree, name, kind, object), blobs(repo, blob, size, content)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..durable import checkpointed, scratch_tables, shuffled_joins
from ..sources.trees import LARGEST, SNIFFED
from . import contain, repository


def readable(blobs: DataFrame) -> DataFrame:
    """Blobs of at most 2 MiB without a zero byte near their start; content may be binary or text."""
    zero = F.position(F.lit(b"\0"), F.substring(F.col("content").cast("binary"), 1, SNIFFED))
    return blobs.where((F.col("size") <= LARGEST) & (zero == 0))


def _written(time: Column | None = None) -> Column:
    """A commit's own time in seconds."""
    return F.coalesce(F.col("author_time").cast("timestamp").cast("long") if time is None else time, F.lit(0))


def ordered(commits: DataFrame, time: Column | None = None) -> DataFrame:
    """(repo, commit, place): a number that grows from parents to children, and with the commits' times where these do so too.

    place is the least number that isn't below the commit's own time and is above all its parents' places. Commits with one parent
    form chains; a chain's place is the larger of a constant and the place of its start plus a length, and both double their reach in
    each round. Merges are settled after that, in as many rounds as clocks run back over merges. A parent that isn't among the
    commits is none; without a time a commit counts as written at 0.
    """
    with shuffled_joins(commits.sparkSession), scratch_tables() as keep:
        own = _written(time)
        rows = checkpointed(commits.groupBy("repo", "commit").agg(F.max(own).alias("at"), F.array_distinct(F.flatten(F.collect_set("parents"))).alias("parents")))
        links = rows.select("repo", "commit", F.explode("parents").alias("parent")).where("parent <> commit")
        links = checkpointed(links.join(rows.select("repo", F.col("commit").alias("parent")), ["repo", "parent"], "left_semi"))
        count = links.groupBy("repo", "commit").agg(F.count("*").alias("n"), F.min("parent").alias("anchor"))
        chains = checkpointed(rows.join(count.where("n = 1"), ["repo", "commit"]).select("repo", "commit", "anchor", F.col("at").alias("least"), F.lit(1).cast("long").alias("more")))
        while True:
            back = chains.select("repo", F.col("commit").alias("anchor"), F.col("anchor").alias("earlier"), F.col("least").alias("b_least"), F.col("more").alias("b_more"))
            moved = chains.join(back, ["repo", "anchor"], "left")
            if moved.where("earlier is not null").isEmpty():
                break
            found = F.col("earlier").isNotNull()
            least = F.when(found, F.greatest("least", F.col("b_least") + F.col("more"))).otherwise(F.col("least"))
            chains = checkpointed(moved.select("repo", "commit", F.coalesce("earlier", "anchor").alias("anchor"), least.alias("least"), (F.col("more") + F.coalesce("b_more", F.lit(0))).alias("more")))
        rest = rows.join(chains.select("repo", "commit"), ["repo", "commit"], "left_anti").select("repo", "commit", F.col("at").alias("place"))
        rest = checkpointed(rest)
        merges = links.join(count.where("n > 1").select("repo", "commit"), ["repo", "commit"], "left_semi")
        through = chains.select("repo", F.col("commit").alias("parent"), "anchor", "least", "more")
        merges = merges.join(through, ["repo", "parent"], "left").select("repo", "commit", F.coalesce("anchor", "parent").alias("anchor"), F.coalesce("least", F.lit(0)).alias("least"), F.coalesce("more", F.lit(0)).alias("more"))
        merges = checkpointed(merges)
        while not merges.isEmpty():
            above = merges.join(rest.select("repo", F.col("commit").alias("anchor"), "place"), ["repo", "anchor"]).groupBy("repo", "commit").agg(F.max(F.greatest("least", F.col("place") + F.col("more")) + 1).alias("floor"))
            changed = rest.join(above, ["repo", "commit"]).where("floor > place")
            if changed.isEmpty():
                break
            rest = checkpointed(rest.join(above, ["repo", "commit"], "left").select("repo", "commit", F.greatest("place", F.coalesce("floor", "place")).alias("place")))
        of_chain = chains.join(rest.select("repo", F.col("commit").alias("anchor"), "place"), ["repo", "anchor"]).select("repo", "commit", F.greatest("least", F.col("place") + F.col("more")).alias("place"))
        return keep(of_chain.unionByName(rest))


def _parents(commits: DataFrame) -> DataFrame:
    """(repo, commit, parent): each commit with its parents among the commits, or once with none."""
    links = commits.select("repo", "commit", F.explode("parents").alias("parent")).where("parent <> commit").distinct()
    links = links.join(commits.select("repo", F.col("commit").alias("parent")).distinct(), ["repo", "parent"], "left_semi")
    return commits.select("repo", "commit").distinct().join(links, ["repo", "commit"], "left")


def changes(commits: DataFrame, trees: DataFrame) -> DataFrame:
    """(repo, commit, parent, path, before, after): what each commit changes against each parent, or against nothing without one; blobs that come or go.

    Pairs of trees are compared entry by entry, a level a round; pairs of equal trees are never opened, and a pair that many
    commits share is compared once.
    """
    with shuffled_joins(commits.sparkSession), scratch_tables() as keep:
        root = _parents(commits).join(commits.select("repo", "commit", "tree").distinct(), ["repo", "commit"])
        old = commits.select("repo", F.col("commit").alias("parent"), F.col("tree").alias("old")).distinct()
        pairs = root.join(old, ["repo", "parent"], "left").where(~F.col("tree").eqNullSafe(F.col("old"))).select("repo", "commit", "parent", F.lit("").alias("folder"), "old", F.col("tree").alias("new"))
        pairs, out = checkpointed(pairs), None
        while not pairs.isEmpty():
            asked = pairs.select("repo", "old", "new").distinct()
            was = asked.join(trees.select("repo", F.col("tree").alias("old"), "name", F.col("kind").alias("old_kind"), F.col("object").alias("was")), ["repo", "old"])
            now = asked.join(trees.select("repo", F.col("tree").alias("new"), "name", F.col("kind").alias("new_kind"), F.col("object").alias("now")), ["repo", "new"])
            side = was.select("repo", "old", "new", "name", F.struct("old_kind", "was").alias("o"), F.lit(None).cast("struct<new_kind:string,now:string>").alias("n"))
            side = side.unionByName(now.select("repo", "old", "new", "name", F.lit(None).cast("struct<old_kind:string,was:string>").alias("o"), F.struct("new_kind", "now").alias("n")))
            entry = side.groupBy("repo", F.coalesce("old", F.lit("")).alias("old_key"), F.coalesce("new", F.lit("")).alias("new_key"), "name").agg(F.max("o").alias("o"), F.max("n").alias("n"))
            entry = entry.where(~(F.col("o.was").eqNullSafe(F.col("n.now")) & F.col("o.old_kind").eqNullSafe(F.col("n.new_kind"))))
            keyed = pairs.withColumns({"old_key": F.coalesce("old", F.lit("")), "new_key": F.coalesce("new", F.lit(""))}).drop("old", "new")
            of = lambda side, kind, name: F.when(F.col(f"{side}.{'old' if side == 'o' else 'new'}_kind") == kind, F.col(f"{side}.{name}"))
            found = checkpointed(keyed.join(entry, ["repo", "old_key", "new_key"]).select(
                "repo", "commit", "parent", F.concat("folder", "name").alias("path"), of("o", "blob", "was").alias("before"), of("n", "blob", "now").alias("after"), of("o", "tree", "was").alias("old"), of("n", "tree", "now").alias("new")))
            blobs = found.where("before is not null or after is not null").select("repo", "commit", "parent", "path", "before", "after")
            out = blobs if out is None else out.unionByName(blobs)
            pairs = found.where("old is not null or new is not null").select("repo", "commit", "parent", F.concat("path", F.lit("/")).alias("folder"), "old", "new")
        return keep(out if out is not None else pairs.select("repo", "commit", "parent", F.col("folder").alias("path"), F.col("old").alias("before"), F.col("new").alias("after")))


def tree_files(roots: DataFrame, trees: DataFrame) -> DataFrame:
    """(repo, tree, path, blob) of roots(repo, tree): all files below, a level a round."""
    with shuffled_joins(roots.sparkSession), scratch_tables() as keep:
        folders, out = checkpointed(roots.select("repo", "tree", F.lit("").alias("folder"), F.col("tree").alias("at")).distinct()), None
        while not folders.isEmpty():
            entry = trees.select("repo", F.col("tree").alias("at"), "name", "kind", "object")
            found = checkpointed(folders.join(entry, ["repo", "at"]).select("repo", "tree", F.concat("folder", "name").alias("path"), "kind", "object"))
            files = found.where("kind = 'blob'").select("repo", "tree", "path", F.col("object").alias("blob"))
            out = files if out is None else out.unionByName(files)
            folders = found.where("kind = 'tree'").select("repo", "tree", F.concat("path", F.lit("/")).alias("folder"), F.col("object").alias("at"))
        return keep(out if out is not None else folders.select("repo", "tree", F.col("folder").alias("path"), F.col("at").alias("blob")))


def leaks(found: DataFrame, blobs: DataFrame, commits: DataFrame, trees: DataFrame) -> DataFrame:
    """(repo, secret, rule, severity, blob, first_commit, place, day): secrets of readable blobs that no text of the repository's newest tree holds.

    found(repo, blob, rule, severity, secret) are the secrets of the blobs; one value counts once, with its least blob and rule. The newest
    commit is the last of ordered(). A blob that no commit has (an object without a path) has no commit, and the place says only that.
    """
    with shuffled_joins(commits.sparkSession), scratch_tables() as keep:
        known = checkpointed(_followed(commits, trees))
        texts = readable(blobs).join(known.where("newest").select("repo", "blob"), ["repo", "blob"], "left_semi").select("repo", F.col("content").alias("text"))
        first = found.groupBy("repo", F.col("secret").alias("needle")).agg(F.min(F.struct("blob", "rule", "severity")).alias("r")).select("repo", "needle", "r.*")
        first = checkpointed(first)  # read twice, and the search for secrets costs most
        gone = contain.standing_nowhere(first, texts, ["repo"])
        known = known.where("touched").select("repo", "blob", "first_commit", F.col("first_author").alias("author"), F.col("first_time").alias("day"))
        out = gone.join(known, ["repo", "blob"], "left").select("repo", F.col("needle").alias("secret"), "rule", "severity", "blob", "first_commit", place_text(F.col("first_commit"), F.col("author"), F.col("day")).alias("place"), "day")
        return keep(out)


def blob_commits(commits: DataFrame, trees: DataFrame) -> DataFrame:
    """(repo, blob, first_commit, first_path, first_author, first_time, last_commit, paths): of each blob that a commit brings or takes away the first commit that brings it,
    the last one that touches it, and the number of its paths. First and last are by ordered(), then by commit and path.

    A merge counts for what none of its parents has at the path, so an object that came with a branch belongs to the branch's commit. paths are those
    at which a commit brought it. Rows of trees that are equal count once.
    """
    with shuffled_joins(commits.sparkSession), scratch_tables() as keep:
        return _followed(commits, trees, keep).where("touched").select("repo", "first_commit", "blob", "first_path", "last_commit", "paths", "first_author", "first_time")


def _followed(commits: DataFrame, trees: DataFrame, keep: Callable[[DataFrame], DataFrame] = checkpointed) -> DataFrame:
    """repository.followed() of all repositories: those of bounded size are followed in a task each, the others and odd ones by joins. keep() writes the result."""
    sizes = checkpointed(commits.select("repo").unionByName(trees.select("repo")).groupBy("repo").agg(F.count("*").alias("n")))
    count = sizes.agg(F.sum("n")).first()[0] or 0
    large = sizes.where(F.col("n") > repository.LARGEST_ROWS).select("repo")
    kept = lambda rows: rows if large.isEmpty() else rows.join(large, "repo", "left_anti")
    small = keep(repository.followed(kept(commits), kept(trees), _written(), count))
    odd = large.unionByName(small.where("blob is null and not touched and not newest").select("repo"))
    out = small.where("blob is not null")
    if odd.isEmpty():
        return out
    commits = checkpointed(commits.join(odd, "repo", "left_semi"))
    trees = checkpointed(trees.join(odd, "repo", "left_semi").distinct())
    place = ordered(commits)
    newest = commits.join(place, ["repo", "commit"]).groupBy("repo").agg(F.max_by("tree", F.struct("place", "commit")).alias("tree"))
    files = tree_files(newest, trees).where("blob is not null").select("repo", "blob", F.lit(True).alias("newest")).distinct()
    touched = _joined_commits(commits, trees, place).withColumn("touched", F.lit(True)).join(files, ["repo", "blob"], "full")
    return out.unionByName(keep(touched.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("touched", "newest")})))


def _joined_commits(commits: DataFrame, trees: DataFrame, place: DataFrame) -> DataFrame:
    """blob_commits() by joins, for repositories of any size. place is ordered(commits)."""
    made = changes(commits, trees)
    parents = _parents(commits).groupBy("repo", "commit").agg(F.count("*").alias("n_parents"))
    both = made.groupBy("repo", "commit", "path").agg(F.count("*").alias("n"), F.max("after").alias("after"), F.collect_set("before").alias("gone"))
    both = both.join(parents, ["repo", "commit"]).where("n >= n_parents").join(place, ["repo", "commit"])
    touched = both.select("repo", "commit", "path", "place", F.explode(F.array_union(F.array_compact(F.array("after")), "gone")).alias("blob"), "after").withColumn("brings", F.col("blob").eqNullSafe(F.col("after")))
    at = F.struct("place", "commit", "path")
    found = touched.groupBy("repo", "blob").agg(F.min(F.when(F.col("brings"), at)).alias("first"), F.max(at).alias("last"), F.count_distinct(F.when(F.col("brings"), F.col("path"))).alias("paths"))
    author = commits.select("repo", F.col("commit").alias("first_commit"), F.col("author").alias("first_author"), F.col("author_time").alias("first_time"))
    found = found.select("repo", "blob", F.col("first.commit").alias("first_commit"), F.col("first.path").alias("first_path"), F.col("last.commit").alias("last_commit"), "paths")
    return found.join(author, ["repo", "first_commit"], "left")


def place_text(commit: Column, author: Column, day: Column) -> Column:
    """Where a finding of the history stands, for reports."""
    said = F.concat(F.lit("git history @ "), commit, F.lit(" ("), F.coalesce(author, F.lit("")), F.lit(", "), F.date_format(day, "yyyy-MM-dd"), F.lit(")"))
    return F.coalesce(said, F.lit("git history"))
