"""Named references: (name, key, created[, deleted]); the current key of a name is its newest row's."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from buildtrail.functions.scalars import cache_ref, is_canonical_hex_key, parse_cache_ref


def current_refs(log: DataFrame) -> DataFrame:
    """Last write wins by (created, key); names whose last row is a delete are gone."""
    last = log.groupBy("name").agg(F.max_by(F.struct("key", "created", "deleted"), F.struct("created", "key")).alias("r"))
    return last.filter(~F.col("r.deleted")).select("name", "r.key", "r.created")


def upsert_refs(current: DataFrame, updates: DataFrame) -> DataFrame:
    """current with updates (name, key, created, deleted) applied."""
    return current_refs(current.withColumn("deleted", F.lit(False)).unionByName(updates))


def missing_deletes(current: DataFrame, updates: DataFrame) -> DataFrame:
    """Deletes of names that aren't there."""
    return updates.filter("deleted").join(current, "name", "left_anti")


def cas_refs(current: DataFrame, updates: DataFrame) -> DataFrame:
    """updates (name, expected_old, key) with now (the current key) and applied: only where expected_old is it (NULL: the name must not exist)."""
    now = current.select("name", F.col("key").alias("now"))
    return updates.join(now, "name", "left").withColumn("applied", F.col("expected_old").eqNullSafe(F.col("now")))


def delete_scratch(refs: DataFrame, names: DataFrame, prefix: str) -> DataFrame:
    """names with outcome: deleted, missing, or refused for names outside the prefix."""
    known = refs.select("name", F.lit(True).alias("__there"))
    outcome = F.when(~F.col("name").startswith(prefix), "refused").when(F.col("__there"), "deleted").otherwise("missing")
    return names.join(known, "name", "left").select("name", outcome.alias("outcome"))


def browse_refs(refs: DataFrame, prefix: str, limit: int = 0) -> DataFrame:
    """Refs under a prefix in name order; limit 0 is all."""
    out = refs.filter(F.col("name").startswith(prefix)).orderBy("name")
    return out.limit(limit) if limit else out


def page_tags(tags: DataFrame, last: str, n: int) -> DataFrame:
    """The next n names after last, and on each row whether the list goes on."""
    page = tags.filter(F.col("name") > last).select("name").distinct().orderBy("name").limit(n + 1)  # n + 1 rows
    w = Window.orderBy("name")
    return page.withColumn("nth", F.row_number().over(w)).withColumn("more", F.count("*").over(Window.partitionBy()) > n).filter(F.col("nth") <= n)


# The ref that says a node of a kind is done, the refs that a kind may propose.
OUTPUTS = {"import": "import-output", "buildfrom": "build-from", "pluginresolve": "build-plugin-resolved", "pin": "build-pinned", "buildrun": "build-output"}
CARRIERS = ("buildfrom", "pluginresolve", "pin")


def by_kind(kind: Column, values: dict[str, str]) -> Column:
    return reduce(lambda out, x: F.when(kind == x[0], F.lit(x[1])).otherwise(out), values.items(), F.lit(None).cast("string"))


def named(refs: DataFrame, prefix: str, key: str, out: str) -> DataFrame:
    """refs of a prefix as (key: what follows the colon, out: the ref's value)."""
    return refs.filter(F.col("name").startswith(prefix + ":")).select(F.substring("name", len(prefix) + 2, 1 << 20).alias(key), F.col("key").alias(out))


def done_nodes(nodes: DataFrame, refs: DataFrame) -> DataFrame:
    """nodes (node, kind, key, ...) whose output ref exists; a buildvalue is done if build-from:key names an f and build-output:f exists."""
    plain = nodes.withColumn("__out", F.concat(by_kind(F.col("kind"), OUTPUTS), F.lit(":"), F.col("key")))
    one = plain.filter("kind <> 'buildvalue'").join(refs.select(F.col("name").alias("__out")), "__out", "left_semi")
    two = nodes.filter("kind = 'buildvalue'").join(named(refs, "build-from", "key", "__f"), "key")
    two = two.withColumn("__out", F.concat(F.lit("build-output:"), "__f")).join(refs.select(F.col("name").alias("__out")), "__out", "left_semi")
    return one.select(*nodes.columns).unionByName(two.select(*nodes.columns))


def resolve_outputs(ks: DataFrame, refs: DataFrame, deps: bool = False) -> DataFrame:
    """(k, f, output): build-from:k gives f, then build-output:f (with deps: build-output-deps:f), or else that of k itself."""
    kind = "build-output-deps" if deps else "build-output"
    hop = ks.join(named(refs, "build-from", "k", "f"), "k", "left").join(named(refs, kind, "f", "via"), "f", "left").join(named(refs, kind, "k", "own"), "k", "left")
    return hop.select("k", "f", F.coalesce("via", "own").alias("output"))


def heal_carriers(wanted: DataFrame, refs: DataFrame) -> DataFrame:
    """The wanted refs (name, key) to insert: those whose name is absent."""
    return wanted.join(refs.select("name"), "name", "left_anti")


def seed_missing(artifacts: DataFrame, refs: DataFrame) -> DataFrame:
    """artifacts (name, key, content) -> the refs (name, key) to put: each artifact and its marker, unless the marker of this very content is there.

    A marker's name holds the content's hash, so a changed blob is seeded again.
    """
    marked = artifacts.withColumn("__m", F.concat(F.lit("seeded:"), "name", F.lit(":"), F.substring(F.sha2("content", 256), 1, 16)))
    new = marked.join(refs.select(F.col("name").alias("__m")), "__m", "left_anti")
    pair = F.array(F.struct(F.col("name"), F.col("key")), F.struct(F.col("__m").alias("name"), F.col("key")))
    return new.select(F.explode(pair).alias("r")).select("r.*")


def gate_refs(proposals: DataFrame, caches: DataFrame) -> DataFrame:
    """Adds reason (NULL: allowed) and accepted to proposals (batch, kind, node_key, platform, name, key): one bad ref rejects its whole batch.

    A kind may publish its own output under its own node_key, a buildrun also its deps and declared caches (caches: build, id) on its
    placement platform, the kinds before it build-from-tree:<f> whose value is f itself, a buildfrom only the f of its own batch's
    build-from ref, which must be a key. A buildvalue may publish nothing.
    """
    p = proposals.withColumn("__id", parse_cache_ref("name")["id"]).withColumn("__plat", parse_cache_ref("name")["platform"])
    declared = caches.select(F.col("build").alias("node_key"), F.col("id").alias("__id"), F.lit(True).alias("__declared")).distinct()
    p = p.join(declared, ["node_key", "__id"], "left")
    family, value = F.substring_index("name", ":", 1), F.substring("name", len("build-from-tree:") + 1, 1 << 20)
    batch = Window.partitionBy("batch")
    reported = F.max(F.when((F.col("kind") == "buildfrom") & (F.col("name") == F.concat(F.lit("build-from:"), "node_key")), F.col("key"))).over(batch)
    cache = F.when(F.col("kind") != "buildrun", "not permitted").when(F.col("__id").isNull(), "malformed cache name")
    cache = cache.when(F.col("__plat") != F.col("platform"), "other platform").when(F.col("__declared").isNull(), "cache not declared")
    tree = F.when(~F.col("kind").isin(*CARRIERS), "not permitted").when(~is_canonical_hex_key(value), "no canonical key").when(value != F.col("key"), "value is not the name's key")
    tree = tree.when((F.col("kind") == "buildfrom") & ~F.col("__f").eqNullSafe(value), "not this batch's build-from")
    own = F.concat(by_kind(F.col("kind"), OUTPUTS), F.lit(":"), F.col("node_key"))
    more = F.when(F.col("kind") == "buildrun", F.concat(F.lit("build-output-deps:"), F.col("node_key")))
    other = F.when(~F.coalesce(F.col("name") == own, F.lit(False)) & ~F.coalesce(F.col("name") == more, F.lit(False)), "not permitted")
    no_key = (F.col("kind") == "buildfrom") & (F.col("name") == own) & ~F.coalesce(is_canonical_hex_key(F.lower("key")), F.lit(False))
    reason = F.when(no_key, "bad key value").when(family == "build-cache", cache).when(family == "build-from-tree", tree).otherwise(other)
    out = p.withColumn("__f", reported).withColumn("reason", reason).drop("__id", "__plat", "__declared", "__f")
    return out.withColumn("accepted", F.bool_and(F.col("reason").isNull()).over(batch))


def pull_refs(nodes: DataFrame, inputs: DataFrame, caches: DataFrame, refs: DataFrame) -> DataFrame:
    """(node, names, missing): the distinct ref names that each job must have before it runs, in order.

    nodes (node, kind, key, platform, fetcher), inputs (node, ord, kind, key: the outputs that it reads), caches (node, id). A build input
    is read through build-from:key; where that ref is missing, its name is in missing. Shells, seed fetchers and caches may be
    absent and are named only where they exist. Joins are shuffled, against tables with a row a
    key: none passes through the driver. Only rows that may be absent are held against refs.
    """
    kind = F.col("kind")
    row = lambda df, ord_, name, optional=False: df.select("node", F.lit(ord_).cast("long").alias("ord") if isinstance(ord_, int) else ord_.alias("ord"), name.alias("name"), F.lit(optional).alias("optional"), F.lit(False).alias("lost"))
    key = lambda prefix: F.concat(F.lit(prefix), F.col("key"))
    shell = F.concat(F.lit("shell:"), F.col("platform"))
    own = [
        row(nodes.filter(kind == "import"), 0, shell, True),
        row(nodes.filter((kind == "import") & F.col("fetcher").isNotNull()), 1, F.concat(F.lit("fetcher:"), "fetcher", F.lit(":"), "platform"), True),
        row(nodes.filter(kind.isin("pluginresolve", "pin")), 0, key("f-tree/")),
        row(nodes.filter(kind == "pin"), 1, key("build-plugin-resolved:")),
        row(nodes.filter(kind == "buildrun"), 0, key("kp-tree/")),
        row(nodes.filter(kind == "buildrun"), 1, key("build-pinned:")),
        row(nodes.filter(kind.isin("pin", "buildrun")), 2, shell, True),
        row(caches.join(nodes.filter(kind == "buildrun").select("node", "platform").hint("merge"), "node"), 1 << 40, cache_ref("id", "platform"), True),
    ]
    held = inputs.select("node", (F.col("ord") * 3 + 3).alias("ord"), F.col("kind").alias("what"), "key").join(nodes.select("node", "kind").hint("shuffle_hash"), "node")
    held = held.join(named(refs, "build-from", "key", "f").hint("shuffle_hash"), "key", "left")
    deps = kind.isin("buildfrom", "buildrun", "import")
    names = F.when(F.col("what") == "import", F.array(key("import-output:"))).when(F.col("what") == "tree", F.array(key("build-from-tree:")))
    names = names.when(F.col("f").isNull(), F.array(key("build-from:")))
    names = names.when(deps, F.array(key("build-from:"), F.concat(F.lit("build-output:"), "f"), F.concat(F.lit("build-output-deps:"), "f"))).otherwise(F.array(key("build-from:"), F.concat(F.lit("build-output:"), "f")))
    lost = (F.col("what") == "build") & F.col("f").isNull()
    read = held.select("node", "ord", lost.alias("lost"), (kind == "import").alias("loose"), F.posexplode(names).alias("i", "name"))
    read = read.select("node", (F.col("ord") + F.col("i")).alias("ord"), "name", (F.col("loose") & (F.col("i") == 2)).alias("optional"), "lost")
    every = reduce(DataFrame.unionByName, [*own, read])
    there = every.filter("not optional").unionByName(every.filter("optional").join(refs.select("name").hint("merge"), "name", "left_semi").select(*every.columns))
    first = there.repartition(F.col("node")).groupBy("node", "name").agg(F.min("ord").alias("ord"), F.bool_or("lost").alias("lost"))
    listed = first.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("ord", "name", "lost"))).alias("r"))  # a job's refs
    pick = lambda bad: F.transform(F.filter("r", lambda x: x["lost"] == bad), lambda x: x["name"])
    return listed.select("node", pick(False).alias("names"), pick(True).alias("missing"))


def resolve_images(ks: DataFrame, refs: DataFrame, trees: DataFrame, deps: DataFrame, defs: DataFrame, default_platform: str) -> DataFrame:
    """ks (k) -> (k, f, artifact, deps, platform, shell, entrypoint, error): what an image of each build key is made of.

    trees (root, path, content_key): the artifact is entry c of the output's tree, the entrypoint that tree's JOBS.entrypoint;
    deps (root, key); defs (k, platform). A key without build-from is its own f. error: no output, or an output without an artifact.
    Joins are merged: none passes through the driver.
    """
    hop = ks.join(named(refs, "build-from", "k", "f").hint("merge"), "k", "left").withColumn("f", F.coalesce("f", "k"))
    hop = hop.join(named(refs, "build-output", "f", "root").hint("merge"), "f", "left").join(named(refs, "build-output-deps", "f", "deps_root").hint("merge"), "f", "left")
    entry = lambda path, out: trees.filter(F.col("path") == path).select("root", F.col("content_key").alias(out)).hint("merge")
    hop = hop.join(entry("c", "artifact"), "root", "left")
    hop = hop.join(entry("JOBS.entrypoint", "entrypoint").withColumnRenamed("root", "artifact"), "artifact", "left")
    listed = deps.groupBy(F.col("root").alias("deps_root")).agg(F.sort_array(F.collect_set("key")).alias("deps"))
    hop = hop.join(listed.hint("merge"), "deps_root", "left").join(defs.select("k", "platform").hint("merge"), "k", "left").withColumn("platform", F.coalesce("platform", F.lit(default_platform)))
    hop = hop.join(named(refs, "shell", "platform", "shell").hint("merge"), "platform", "left")
    error = F.when(F.col("root").isNull(), "no output").when(F.col("artifact").isNull(), "no artifact")
    return hop.select("k", "f", "artifact", F.coalesce("deps", F.array().cast("array<string>")).alias("deps"), "platform", "shell", "entrypoint", error.alias("error"))


def apply_labels(nodes: DataFrame, edges: DataFrame, proposals: DataFrame) -> DataFrame:
    """nodes (node, kind, label) with final labels.

    proposals (node, ord, name, label): the first label on a build-pinned: proposal is the recipe's own name; it overrides that node's label
    and those of the buildvalues that depend on it. Of several recipes of one buildvalue the least node's counts. Joins are merged, as the
    planner takes rows of long made-up names for a hundredth of their size and would send them whole through the driver.
    """
    recipe = proposals.filter(F.col("name").startswith("build-pinned:") & (F.coalesce("label", F.lit("")) != "")).groupBy("node").agg(F.min_by("label", "ord").alias("__own"))
    above = edges.join(recipe.select(F.col("node").alias("dep"), F.col("__own").alias("__dep")).hint("merge"), "dep").groupBy("node").agg(F.min_by("__dep", "dep").alias("__below"))
    out = nodes.join(recipe.hint("merge"), "node", "left").join(above.hint("merge"), "node", "left")
    below = F.when(F.col("kind") == "buildvalue", F.col("__below"))
    return out.withColumn("label", F.coalesce(below, "__own", "label")).drop("__own", "__below")


def pullable_tags(refs: DataFrame, images: DataFrame) -> DataFrame:
    """Distinct keys of build-from: refs and of images (k) that have a key's form."""
    named = refs.filter(F.col("name").startswith("build-from:")).select(F.substring("name", len("build-from:") + 1, 1 << 20).alias("k"))
    return named.unionByName(images.select("k")).filter(is_canonical_hex_key("k")).distinct()


def list_requests(requests: DataFrame, limit: int = 0) -> DataFrame:
    """Newest first, ties by id."""
    out = requests.orderBy(F.desc("created"), "request")
    return out.limit(limit) if limit else out
