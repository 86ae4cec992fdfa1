"""Ignore patterns of source trees: entries (path, is_dir) and control files (dir, content), one for a directory, "" for the root."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from buildtrail.operators.store import ancestors

FEW_RULES = 20_000  # rules are broadcast up to this number, and shuffled beyond


def pattern_regex(pattern: Column) -> Column:
    """The regular expression, for a path below the pattern's directory, of a pattern without ``!`` and closing slash."""
    sub = F.regexp_replace
    anchored = pattern.contains("/") & ~F.regexp_like(pattern, F.lit(r"^\*\*/[^/]*$"))
    p = sub(sub(pattern, "^/", ""), r"\\([A-Za-z0-9])", "$1")
    p = sub(sub(p, r"\[[!^]", "\u0001"), r"([.+^$(){}|])", r"\\$1")
    p = sub(sub(sub(p, r"(^|/)(\*\*/)+", "$1\u0002"), r"/\*\*$", "/\u0003"), r"(?<!\\)\?", "[^/]")
    p = sub(sub(p, r"(?<!\\)\*+", "[^/]*"), "\u0001", "[^")
    p = sub(sub(p, "\u0002", "(?:.*/)?"), "\u0003", ".+")
    return F.concat(F.lit("(?s)^"), F.when(anchored, "").otherwise("(?:.*/)?"), p, F.lit("$"))


def ignore_rules(control: DataFrame) -> DataFrame:
    """control (dir, content) -> (dir, ord, negated, dirs_only, regex): a row a pattern; blank lines and comments are none."""
    lines = control.select("dir", F.posexplode(F.split("content", "\r?\n")).alias("ord", "line"))
    line = F.regexp_replace("line", r"(?<!\\)[ \t]+$", "")
    rows = lines.select("dir", "ord", line.alias("line")).filter((F.col("line") != "") & ~F.startswith("line", F.lit("#")))
    negated = F.startswith("line", F.lit("!"))
    bare = F.when(negated, F.expr("substring(line, 2)")).otherwise(F.col("line"))
    rows = rows.select("dir", "ord", negated.alias("negated"), F.endswith(bare, F.lit("/")).alias("dirs_only"), F.regexp_replace(bare, "/+$", "").alias("p"))
    return rows.filter("p <> ''").select("dir", "ord", "negated", "dirs_only", pattern_regex(F.col("p")).alias("regex"))


def ignore_match(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """(path, is_dir, ignored): what the last matching pattern of the deepest directory says of each path itself; false without any."""
    rows = paths.select("path", "is_dir").distinct()
    above = F.concat(F.array(F.lit("")), F.filter(ancestors(F.col("path")), lambda p: p != F.col("path")))
    few = rules.limit(FEW_RULES + 1).count() <= FEW_RULES
    met = rows.select("path", "is_dir", F.posexplode(above).alias("depth", "dir")).join(F.broadcast(rules) if few else rules, "dir")
    inner = F.when(F.col("dir") == "", F.col("path")).otherwise(F.expr("substring(path, length(dir) + 2)"))
    hit = met.filter((F.col("is_dir") | ~F.col("dirs_only")) & F.regexp_like(inner, F.col("regex")))
    said = hit.groupBy("path", "is_dir").agg(F.max_by(~F.col("negated"), F.struct("depth", "ord")).alias("said"))
    return rows.join(said, ["path", "is_dir"], "left").select("path", "is_dir", F.coalesce("said", F.lit(False)).alias("ignored"))


def filter_source_tree(entries: DataFrame, control: DataFrame, name: str = ".ignore", vcs: str = ".git") -> DataFrame:
    """entries without ``vcs`` at any level, without the control files themselves, and without what the patterns ignore.

    A directory that is ignored takes all below it along, whatever deeper patterns say. Each directory is judged once, not
    once for each file below it.
    """
    rows = entries.filter(~F.array_contains(F.split("path", "/"), vcs) & (F.col("is_dir") | (F.substring_index("path", "/", -1) != name)))
    dirs = rows.select(F.explode(F.filter(ancestors(F.col("path")), lambda p: p != F.col("path"))).alias("path")).distinct().withColumn("is_dir", F.lit(True))
    judged = ignore_match(rows.select("path", "is_dir").unionByName(dirs), ignore_rules(control)).filter("ignored")
    up = F.explode(F.transform(ancestors(F.col("path")), lambda p: F.struct(p.alias("up"), (F.col("is_dir") | (p != F.col("path"))).alias("up_dir")))).alias("u")
    below = rows.select("path", "is_dir", up).select("path", "is_dir", "u.*").join(judged.select(F.col("path").alias("up"), F.col("is_dir").alias("up_dir")), ["up", "up_dir"], "left_semi")
    return rows.join(below.select("path", "is_dir").distinct(), ["path", "is_dir"], "left_anti")


def runnerless_requests(seen: DataFrame, requests: DataFrame, live_s: int, patience_s: int, salts: int = 8) -> DataFrame:
    """Batch form of ``stream_runnerless``: seen (platform, us), requests (platform, request, us, ended_us) -> (platform, request, failed_us).

    Only gaps of at least the patience count. Each request meets the first gap that lasts beyond its patience; a platform's
    requests are dealt over ``salts`` groups, its few gaps go to each. The last gap of a platform never ends.
    """
    live, patience = live_s * 1_000_000, patience_s * 1_000_000
    w = Window.partitionBy("platform").orderBy("us")
    beats = seen.select("platform", "us").dropna().distinct()
    after = beats.select("platform", (F.col("us") + live).alias("low"), F.lead("us").over(w).alias("high"))
    first = beats.groupBy("platform").agg(F.min("us").alias("high")).select("platform", F.lit(None).cast("long").alias("low"), "high")
    never = requests.select("platform").distinct().join(beats, "platform", "left_anti").select("platform", F.lit(None).cast("long").alias("low"), F.lit(None).cast("long").alias("high"))
    end = F.lit((1 << 62) - 1)
    gaps = after.unionByName(first).unionByName(never).withColumn("high", F.coalesce("high", end)).filter(F.col("low").isNull() | (F.col("high") - F.col("low") > patience))
    dealt = gaps.select("platform", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.col("high").alias("at"), F.lit(0).alias("turn"), F.struct("low", "high").alias("gap"), F.lit(None).cast(requests.schema["request"].dataType).alias("request"), F.lit(None).cast("long").alias("us"), F.lit(None).cast("long").alias("ended_us"))
    asked = requests.filter("request is not null and us is not null").select("platform", F.pmod(F.xxhash64("request"), F.lit(salts)).cast("int").alias("salt"), (F.col("us") + patience).alias("at"), F.lit(1).alias("turn"), F.lit(None).cast("struct<low:bigint,high:bigint>").alias("gap"), "request", "us", "ended_us")
    ahead = Window.partitionBy("platform", "salt").orderBy("at", "turn").rowsBetween(0, Window.unboundedFollowing)
    met = dealt.unionByName(asked).withColumn("gap", F.first("gap", ignorenulls=True).over(ahead)).filter("turn = 1 and gap is not null")
    failed = F.greatest("us", "gap.low") + patience
    return met.withColumn("failed_us", failed).filter("ended_us is null or ended_us > failed_us").select("platform", "request", "failed_us")
