"""Covers of source trees: links, covered paths, pruned and overlaid trees, and identities of covered builds.

Many trees at once: entries are (tree, path, kind, mode, content_key, target), kind one of "file", "dir" and "link"; directories
that only lie in paths needn't have rows. What can't be done becomes a row that says why, never a job that fails.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buildtrail.functions.scalars import clean_path
from buildtrail.lineage import checkpointed
from buildtrail.operators.store import ancestors, merkle_trees

# Links that one path may traverse, the version of covers in identities, modes of made entries, bytes of generated files.
LINK_BUDGET, COVER_VERSION, FILE_MODE, DIR_MODE, GENERATED_CAP = 40, 2, 0o444, 0o555, 1 << 20
FEW_LINKS = 50_000  # links are broadcast up to this number, and shuffled beyond


def above(path: Column) -> Column:
    """The directories above a path, without the root."""
    return F.filter(ancestors(path), lambda p: p != path)


def dirname(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def root_relative(path: Column) -> Column:
    """The cleaned path below the root, "" for the root itself; ".." can't leave it."""
    return F.regexp_replace(clean_path(F.concat(F.lit("/"), path)), "^/+", "")


def link_goal(link: Column, target: Column) -> Column:
    """Where a link points to, from the root: "." for the root, ".." or "../..." beyond it, NULL for an absolute target."""
    return F.when(~F.startswith(target, F.lit("/")), clean_path(F.concat(dirname(link), F.lit("/./"), target).substr(F.when(dirname(link) == "", F.lit(2)).otherwise(F.lit(1)), F.lit(1 << 30))))


def escapes(goal: Column) -> Column:
    return (goal == "..") | F.startswith(goal, F.lit("../"))


def with_directories(entries: DataFrame) -> DataFrame:
    """entries with a row for each directory that only lies in paths."""
    have = entries.select("tree", "path")
    dirs = entries.select("tree", F.explode(above(F.col("path"))).alias("path")).distinct().join(have, ["tree", "path"], "left_anti")
    fixed = {"tree": F.col("tree"), "path": F.col("path"), "kind": F.lit("dir"), "mode": F.lit(DIR_MODE)}
    return entries.unionByName(dirs.select(*[fixed.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in entries.schema.fields]))


UPS = "transform(sequence(1, size(split(at, '/'))), i -> array_join(slice(split(at, '/'), 1, i), '/'))"
# a row's own columns go along in ``row``; hit is the first link on the way, with where following it to its end leads to
TAKEN = f"""CASE WHEN row.state IS NOT NULL THEN row WHEN hit IS NULL THEN named_struct('at', row.at, 'links', row.links, 'state', 'plain')
  ELSE named_struct('at', concat_ws('/', nullif(hit.at, ''), nullif(substring(row.at, length(hit.up) + 2), '')), 'links', slice(concat(row.links, hit.links), 1, {LINK_BUDGET}),
    'state', CASE WHEN size(row.links) + size(hit.links) > {LINK_BUDGET} THEN 'loop' WHEN hit.state <> 'plain' THEN hit.state END) END"""


def _followed(rows: DataFrame, links: DataFrame, keys: list[str], inner: bool) -> DataFrame:
    """rows (*keys, at, links, state) without a state, each over the first link (tree, link, at, links, state) among the directories of at.

    With inner, at itself counts as one of them. A row is carried through the grouping, so that the plan grows by one join a step.
    """
    ups = UPS if inner else f"filter({UPS}, x -> x <> at)"
    each = rows.selectExpr(*keys, "struct(at, links, state) AS row", f"posexplode_outer(CASE WHEN state IS NULL THEN {ups} END) AS (depth, up)")
    known = links.selectExpr("tree", "link AS up", "struct(link AS up, at, links, state) AS found")
    met = each.join(known, ["tree", "up"], "left").groupBy(*keys).agg(F.expr("first(row) AS row"), F.expr("min_by(found, CASE WHEN found IS NOT NULL THEN depth END) AS hit"))
    return met.selectExpr(*keys, f"{TAKEN} AS row").selectExpr(*keys, "row.at", "row.links", "row.state")


def link_table(entries: DataFrame) -> DataFrame:
    """(tree, link, target, goal, out, at, links, state) of all links.

    out: "absolute" or "escapes" for a link that leaves the tree. at: where a path through the link goes on, with the links met up to
    there; state: "plain", or why it can't ("loop", "absolute", "escapes"). Each round doubles the links that are followed,
    so chains up to the budget take seven rounds, and longer ones and circles run over it.
    """
    own = entries.filter("kind = 'link'").select("tree", F.col("path").alias("link"), "target", link_goal(F.col("path"), F.col("target")).alias("goal"))
    own = checkpointed(own.withColumn("out", F.when(F.col("goal").isNull(), "absolute").when(escapes(F.col("goal")), "escapes")))
    now = own.selectExpr("tree", "link", "CASE WHEN goal = '.' THEN '' ELSE goal END AS at", "array(link) AS links", "out AS state")
    while not now.filter("state is null").isEmpty():
        now = checkpointed(_followed(now, now, ["tree", "link"], True))
    table = checkpointed(own.join(now, ["tree", "link"]))
    return F.broadcast(table) if table.limit(FEW_LINKS + 1).count() <= FEW_LINKS else table


def _resolved(paths: DataFrame, links: DataFrame, full: DataFrame) -> DataFrame:
    """``resolve_links`` of (tree, path, at), at cleaned; links: ``link_table``, full: entries with all directories."""
    now = paths.selectExpr("tree", "path", "at", "cast(array() AS array<string>) AS links", "CASE WHEN at = '' THEN 'root' END AS state")
    done = []
    while True:
        now = checkpointed(_followed(now, links, ["tree", "path"], False))
        done.append(now.filter("state is not null"))
        now = now.filter("state is null")
        if now.isEmpty():
            break
    ended = reduce(DataFrame.unionByName, done)
    joined = ended.join(full.selectExpr("tree", "path AS at", "kind", "target"), ["tree", "at"], "left")
    ups = joined.selectExpr("tree", "path", "struct(at, links, state, kind, target) AS row", f"explode(CASE WHEN state = 'plain' AND kind IS NULL THEN {UPS} ELSE array('') END) AS up")
    files = full.filter("kind = 'file'").selectExpr("tree", "path AS up", "true AS file")
    rows = ups.join(files, ["tree", "up"], "left").groupBy("tree", "path").agg(F.expr("first(row) AS row"), F.max("file").alias("blocked")).select("tree", "path", "row.*", "blocked")
    last = "state = 'plain' AND kind = 'link'"
    state = f"CASE WHEN state <> 'plain' THEN state WHEN {last} AND size(links) >= {LINK_BUDGET} THEN 'loop' WHEN kind IS NOT NULL THEN 'found' WHEN blocked THEN 'through_file' ELSE 'missing' END AS said"
    out = rows.selectExpr("*", state)
    met = f"CASE WHEN {last} AND size(links) < {LINK_BUDGET} THEN concat(links, array(at)) ELSE links END AS links"
    return out.selectExpr("tree", "path", "CASE WHEN said IN ('found', 'missing', 'through_file') THEN at END AS resolved", "CASE WHEN said = 'found' THEN kind END AS kind", "CASE WHEN said = 'found' THEN target END AS target", met, "said AS state")


def resolve_links(paths: DataFrame, entries: DataFrame) -> DataFrame:
    """Each distinct (tree, path) of paths resolved element by element: (tree, path, resolved, kind, target, links, state).

    links: the links met, in order, at most LINK_BUDGET of them. resolved: where the path ends. state: "found" (resolved has no link but at its end, and
    is an entry of this kind), "missing", "through_file" (an element below a file), "root" (nothing is left of the path), "loop"
    (more links than the budget), "absolute" or "escapes" (a link on the way points out of the tree); for these three resolved is
    NULL. kind and target are NULL unless found. Null paths have no row.
    """
    asked = paths.select("tree", "path").filter("path is not null").distinct().withColumn("at", root_relative(F.col("path")))
    return _resolved(asked, link_table(entries), with_directories(entries))


def covered_paths(builds: DataFrame, declared: DataFrame, entries: DataFrame, allowed: DataFrame) -> DataFrame:
    """The closure of each build: (build, path, outcome, reason), outcome one of "covered", "warning" and "error".

    builds: (build, tree, dir, complete), dir "" for the root. declared: (build, path). allowed: (build, path), links that may point out
    of the tree. Seeds are dir and the declared paths; of complete builds the declared ones alone, which must cover dir. Covered are the
    seeds, every link on their way, at their end or below a covered directory, and what those point to. Errors: a seed that
    is "missing", a path with an error of ``resolve_links``, a link out of the tree that isn't allowed ("absolute", "escapes"), a
    complete build's dir that nothing covers ("dir"), no seed at all ("empty"). A target that doesn't exist is a warning
    ("dangling"), unless it is a seed as well. A build with errors has its error rows alone.

    A path is resolved once a tree, however many builds ask for it; each round carries only the paths that are new.
    """
    full = checkpointed(with_directories(entries))
    links = link_table(full)
    below = links.select("tree", "link", F.explode(above(F.col("link"))).alias("resolved"))
    clean = declared.filter("path is not null").select("build", root_relative(F.col("path")).alias("path"))
    clean = clean.join(builds.select("build", "tree"), "build")
    own = builds.filter("dir <> '' and not complete").select("build", root_relative(F.col("dir")).alias("path"), "tree")
    new = checkpointed(clean.unionByName(own).distinct().withColumn("seed", F.lit(True)))
    errors = [builds.join(new, "build", "left_anti").select("build", F.lit("").alias("path"), F.lit("empty").alias("reason"))]
    seen, covered, warnings = new.select("build", "path"), [], []
    free = allowed.select("build", F.col("path").alias("link"), F.lit(True).alias("free"))
    while not new.isEmpty():
        asked = new.select("tree", "path").distinct().withColumn("at", F.col("path"))
        known = checkpointed(new.join(_resolved(asked, links, full), ["tree", "path"]))
        found = known.filter("state = 'found'")
        covered += [known.select("build", F.explode("links").alias("path")), found.select("build", "path")]
        errors += [known.filter("seed and state = 'missing'").select("build", "path", F.lit("missing").alias("reason")), known.filter("state not in ('found', 'missing')").select("build", "path", F.col("state").alias("reason"))]
        warnings.append(known.filter("not seed and state = 'missing'").select("build", "path"))
        chased = found.filter("kind = 'link'").select("build", "tree", F.col("resolved").alias("link"))
        chased = chased.unionByName(found.filter("kind = 'dir'").select("build", "tree", "resolved").distinct().join(below, ["tree", "resolved"]).select("build", "tree", "link")).distinct()
        chased = checkpointed(chased.join(links.select("tree", "link", "goal", "out"), ["tree", "link"]).join(free, ["build", "link"], "left"))
        errors.append(chased.filter("free is null and out is not null").select("build", F.col("link").alias("path"), F.col("out").alias("reason")))
        goals = chased.filter("out is null").select("build", "tree", F.when(F.col("goal") == ".", "").otherwise(F.col("goal")).alias("path"))
        further = goals.unionByName(found.filter("resolved <> path").select("build", "tree", F.col("resolved").alias("path"))).distinct()
        new = checkpointed(further.join(seen, ["build", "path"], "left_anti").select("build", "path", "tree", F.lit(False).alias("seed")))
        seen = seen.unionByName(new.select("build", "path"))
    inside = reduce(DataFrame.unionByName, covered, new.select("build", "path")).distinct()
    inside = checkpointed(inside)
    asked = builds.filter("complete and dir <> ''").select("build", root_relative(F.col("dir")).alias("path")).join(clean.select("build").distinct(), "build", "left_semi")
    holds = asked.join(inside.select("build", F.explode(ancestors(F.col("path"))).alias("path")), ["build", "path"], "left_semi").unionByName(
        asked.select("build", "path", F.explode(ancestors(F.col("path"))).alias("up")).join(inside.withColumnRenamed("path", "up"), ["build", "up"], "left_semi").select("build", "path")
    )
    errors.append(asked.join(holds.select("build"), "build", "left_anti").select("build", "path", F.lit("dir").alias("reason")))
    wrong = checkpointed(reduce(DataFrame.unionByName, errors).distinct())
    fine = inside.withColumn("outcome", F.lit("covered")).withColumn("reason", F.lit(None).cast("string"))
    warned = reduce(DataFrame.unionByName, warnings, new.select("build", "path")).distinct().withColumn("outcome", F.lit("warning")).withColumn("reason", F.lit("dangling"))
    right = fine.unionByName(warned).join(wrong.select("build").distinct(), "build", "left_anti")
    return right.unionByName(wrong.select("build", "path", F.lit("error").alias("outcome"), "reason"))


def _shortest(keep: DataFrame) -> DataFrame:
    """keep (build, tree, path), cleaned, without the root and without what lies below another path of the build."""
    paths = keep.select("build", "tree", root_relative(F.col("path")).alias("path")).filter("path <> ''").distinct()
    inner = paths.select("build", "path", F.explode(above(F.col("path"))).alias("up")).join(paths.select("build", F.col("path").alias("up")), ["build", "up"], "left_semi").select("build", "path").distinct()
    return paths.join(inner, ["build", "path"], "left_anti")


def prune_trees(entries: DataFrame, keep: DataFrame) -> DataFrame:
    """keep: (build, tree, path). entries at or below each build's paths, and the directories above those: build and the columns of entries but tree."""
    full = with_directories(entries)
    paths = _shortest(keep)
    rest = [c for c in full.columns if c != "tree"]
    inside = full.withColumn("_up", F.explode(ancestors(F.col("path")))).join(paths.withColumnRenamed("path", "_up"), ["tree", "_up"]).select("build", *rest)
    there = inside.select("build", F.explode(above(F.col("path"))).alias("path")).distinct().join(inside.select("build", "path"), ["build", "path"], "left_anti")
    over = there.join(paths.select("build", "tree").distinct(), "build").join(full, ["tree", "path"]).select("build", *rest)
    return inside.unionByName(over)


def prune_errors(builds: DataFrame, entries: DataFrame, keep: DataFrame) -> DataFrame:
    """builds: (build, tree). (build, path, reason) for each build that can't be pruned to keep (build, tree, path).

    Reasons: "root" (a path that is the root), "empty" (no path), "missing" (no such entry), "through_file" (a path below a file or link). What
    lies below another path of the build isn't looked at.
    """
    full = with_directories(entries)
    paths = _shortest(keep)
    root = keep.filter(root_relative(F.col("path")) == "").select("build", "path", F.lit("root").alias("reason")).distinct()
    empty = builds.join(keep.filter("path is not null"), "build", "left_anti").select("build", F.lit("").alias("path"), F.lit("empty").alias("reason"))
    lost = paths.join(full.select("tree", "path"), ["tree", "path"], "left_anti")
    solid = entries.filter("kind <> 'dir'").select("tree", F.col("path").alias("up"))
    blocked = lost.select("build", "tree", "path", F.explode(above(F.col("path"))).alias("up")).join(solid, ["tree", "up"], "left_semi").select("build", "path").distinct()
    blocked = blocked.withColumn("reason", F.lit("through_file"))
    missing = lost.select("build", "path").join(blocked, ["build", "path"], "left_anti").withColumn("reason", F.lit("missing"))
    return root.unionByName(empty).unionByName(missing).unionByName(blocked)


def overlay_trees(entries: DataFrame, files: DataFrame) -> DataFrame:
    """entries (build, path, kind, mode, content_key, target) with files (build, path, content_key) put over them, and origin.

    origin: "kept", "replaced", "added" or "made", the last for directories that a file needs. Files get mode 0444, made directories 0555.
    Builds with a row of ``overlay_errors`` give no tree that can be used.
    """
    put = files.select("build", root_relative(F.col("path")).alias("path"), F.col("content_key").alias("_new")).dropDuplicates(["build", "path"]).withColumn("_put", F.lit(True))
    kinds = {f.name: f.dataType for f in entries.schema.fields}
    both = entries.withColumn("_old", F.lit(True)).join(put, ["build", "path"], "full")
    new = {"kind": F.lit("file"), "mode": F.lit(FILE_MODE).cast(kinds["mode"]), "content_key": F.col("_new"), "target": F.lit(None).cast(kinds["target"])}
    origin = F.when(F.col("_put").isNull(), "kept").when(F.col("_old").isNull(), "added").otherwise("replaced")
    laid = both.select("build", "path", *[F.when(F.col("_put"), c).otherwise(F.col(name)).alias(name) for name, c in new.items()], origin.alias("origin"))
    dirs = put.select("build", F.explode(above(F.col("path"))).alias("path")).distinct().join(entries.select("build", F.explode(ancestors(F.col("path"))).alias("path")), ["build", "path"], "left_anti")
    made = {"kind": F.lit("dir"), "mode": F.lit(DIR_MODE).cast(kinds["mode"]), "content_key": F.lit(None).cast("string"), "target": F.lit(None).cast(kinds["target"]), "origin": F.lit("made")}
    return laid.unionByName(dirs.select("build", "path", *[c.alias(name) for name, c in made.items()]))


def overlay_errors(entries: DataFrame, files: DataFrame) -> DataFrame:
    """(build, path, reason) for each file that can't be put over entries.

    Reasons: "root" (the path is the root), "conflict" (two files of one path), "below_file" (a file below another of files),
    "directory" (a directory is there), "through_file" (an element above it is a file or link of entries).
    """
    put = files.select("build", root_relative(F.col("path")).alias("path"))
    said = lambda df, reason: df.select("build", "path", F.lit(reason).alias("reason")).distinct()
    ups = put.distinct().select("build", "path", F.explode(above(F.col("path"))).alias("up"))
    solid = entries.filter("kind <> 'dir'").select("build", F.col("path").alias("up"))
    dirs = entries.filter("kind = 'dir'").select("build", "path").unionByName(entries.select("build", F.explode(above(F.col("path"))).alias("path"))).distinct()
    found = [
        said(put.filter("path = ''"), "root"),
        said(put.filter("path <> ''").groupBy("build", "path").agg(F.count("*").alias("n")).filter("n > 1"), "conflict"),
        said(ups.join(put.withColumnRenamed("path", "up"), ["build", "up"], "left_semi"), "below_file"),
        said(put.join(dirs, ["build", "path"], "left_semi"), "directory"),
        said(ups.join(solid, ["build", "up"], "left_semi"), "through_file"),
    ]
    return reduce(DataFrame.unionByName, found)


def cover_identity(builds: DataFrame, declared: DataFrame, entries: DataFrame, allowed: DataFrame, files: DataFrame) -> DataFrame:
    """(build, identity, tree_key, problem): the digest of what a build can see.

    builds: (build, tree, dir, complete, platform, pinned), files: (build, path, content), generated. A build without dir and declared
    paths covers its whole tree, others the closure of ``covered_paths``; generated files are put over it, at most GENERATED_CAP
    bytes. The identity is made of pinned, platform, version and the normalised tree, so times, owners and whatever lies
    outside the cover don't change it. With a problem ("cover", "prune", "overlay" or "generated", and its reason) identity is NULL.
    """
    builds = checkpointed(builds)
    named = builds.select("build", "tree", "dir", "complete")
    seeded = declared.filter("path is not null").select("build").distinct()
    whole = named.filter("dir = '' and not complete").join(seeded, "build", "left_anti").select("build", "tree")
    partial = named.join(whole.select("build"), "build", "left_anti")
    closure = checkpointed(covered_paths(partial, declared, entries, allowed))
    keep = closure.filter("outcome = 'covered'").select("build", "path").join(partial.select("build", "tree"), "build")
    full = with_directories(entries)
    sound = partial.join(closure.filter("outcome = 'error'").select("build").distinct(), "build", "left_anti").select("build", "tree")
    pruned = prune_trees(entries, keep).unionByName(whole.join(full, "tree").select("build", *[c for c in full.columns if c != "tree"]))
    pruned = checkpointed(pruned.select("build", "path", "kind", "mode", "content_key", "target"))
    content = F.col("content").cast("binary")
    laid = files.join(named.select("build"), "build", "left_semi").select("build", "path", F.sha2(content, 256).alias("content_key"), F.octet_length(content).alias("bytes"))
    size = laid.groupBy("build").agg(F.sum("bytes").alias("bytes")).filter(F.col("bytes") > GENERATED_CAP)
    told = lambda df, stage: df.select("build", F.concat(F.lit(f"{stage}: "), "reason", F.when(F.col("path") == "", "").otherwise(F.concat(F.lit(" "), "path"))).alias("problem"))
    problems = [
        told(closure.filter("outcome = 'error'"), "cover"),
        told(prune_errors(sound, entries, keep), "prune"),
        told(overlay_errors(pruned, laid), "overlay"),
        size.select("build", F.lit("generated: oversized").alias("problem")),
    ]
    problem = reduce(DataFrame.unionByName, problems).groupBy("build").agg(F.min("problem").alias("problem"))
    trees = overlay_trees(pruned, laid).drop("origin")
    roots = merkle_trees(trees.withColumnRenamed("build", "tree")).filter("path = ''").select(F.col("tree").alias("build"), F.col("digest").alias("tree_key"))
    out = builds.join(roots, "build", "left").join(problem, "build", "left")
    parts = F.concat_ws("\n", F.sha2(F.col("pinned").cast("binary"), 256), F.col("platform"), F.lit(str(COVER_VERSION)), F.col("tree_key"))
    sane = F.col("problem").isNull()
    return out.select("build", F.when(sane, F.sha2(parts, 256)).alias("identity"), F.when(sane, F.col("tree_key")).alias("tree_key"), "problem")
