"""Line dedup by deletion neighbourhoods, with DataFrame functions only.

A line goes when an equal line, or one within an edit distance of 1, stands earlier (by document id,
then line number; whether that one goes too doesn't matter). Lines of fewer than ``near_chars``
characters only go for equal ones, blank lines never.

Two lines are within one edit when deleting one character of the longer leaves the other, or leaves both
the same at one place. All such variants of all lines would be one row a character, so variants
are made block by block: a line is taken in a frame of N characters (its own length, or one more), and
a variant is the frame's place of a deleted block with what is left before and behind it. Lines that share no
variant with another line are done. The blocks of the others are split further, down to single
characters, where an equal variant means one edit. Each group of equal variants is compared with its
earliest line alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from buildtrail.llm.keys import keyed
from buildtrail.llm.session import checkpointed

SPLIT = 32
BROADCAST_ROWS = 500_000  # 8 bytes each


def _variant(low: Column, high: Column) -> Column:
    """Hash of what a line leaves in frame n when its block from low to high is deleted."""
    behind = F.col("n") - high
    tail = F.when(behind > 0, F.col("line").substr(F.length("line") - behind + 1, behind)).otherwise("")
    return F.xxhash64(F.col("n"), low, high, F.col("line").substr(F.lit(1), low), tail)


def _frames(lines: DataFrame) -> DataFrame:
    """Adds n: each line in the frame of its own length and of one character more."""
    return lines.withColumn("n", F.explode(F.array(F.length("line"), F.length("line") + 1)))


def _halves(lines: DataFrame) -> DataFrame:
    """(h1, n, low, high, key): both halves of each frame as the first deleted blocks."""
    middle = F.floor(F.col("n") / 2).cast("int")
    block = F.explode(F.array(F.struct(F.lit(0).alias("low"), middle.alias("high")), F.struct(middle.alias("low"), F.col("n").alias("high"))))
    framed = _frames(lines).withColumn("block", block).select("h1", "line", "n", "block.low", "block.high")
    return framed.select("h1", "n", "low", "high", _variant(F.col("low"), F.col("high")).alias("key"))


def _shared(variants: DataFrame) -> DataFrame:
    """The variants whose key several lines have."""
    keys = variants.groupBy("key").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).filter("a < b").select("key")
    return variants.join(keys, "key", "left_semi")


def removed_lines(texts: DataFrame, near_chars: int = 16) -> DataFrame:
    """texts: (k, rank, text). Returns (k, rank, no): the lines that go, by number from 0."""
    lines = texts.select("k", "rank", F.posexplode(F.split("text", "\n", -1)).alias("no", "line")).filter("trim(line) <> ''")
    lines = lines.withColumn("h1", F.xxhash64("line")).withColumn("h2", F.xxhash64("line", F.lit(1)))
    place = F.struct("rank", "k", "no")
    firsts = lines.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("times"))

    long = lines.filter(F.length("line") >= near_chars).select("h1", "h2", "line")
    halves = checkpointed(_shared(_halves(long)).select("h1", "n", "low", "high").distinct())
    some = halves.select("h1").distinct()
    few = some.count() <= BROADCAST_ROWS
    chosen = long.join(F.broadcast(some) if few else some, "h1", "left_semi").dropDuplicates(["h1", "h2"])
    chosen = checkpointed(chosen.join(firsts.select("h1", "h2", "first"), ["h1", "h2"]))
    blocks = halves
    size = int(blocks.agg(F.max(F.col("high") - F.col("low"))).first()[0] or 1)
    while True:
        size = -(-size // SPLIT)
        step = F.greatest(F.lit(1), F.ceil((F.col("high") - F.col("low")) / SPLIT)).cast("int")
        parts = blocks.filter("high > low").withColumn("step", step).withColumn("at", F.explode(F.expr("sequence(low, high - 1, step)")))
        parts = parts.select("h1", "n", F.col("at").alias("low"), F.least(F.col("at") + F.col("step"), F.col("high")).alias("high"))
        cut = parts.join(chosen.select("h1", "h2", "line", "first"), "h1").withColumn("key", _variant(F.col("low"), F.col("high")))
        if size <= 1:
            break
        blocks = checkpointed(_shared(cut.select("h1", "n", "low", "high", "key")).select("h1", "n", "low", "high").distinct())
    members = cut.select("key", "h1", "h2", "first")
    leaders = members.groupBy("key").agg(F.min("first").alias("lead"), F.min_by(F.struct("h1", "h2"), "first").alias("who"), F.count("*").alias("many")).filter("many > 1")
    earlier = members.join(leaders, "key").filter("lead < first").select("h1", "h2", "who").distinct()
    own = chosen.select("h1", "h2", "line")
    other = chosen.select(F.struct("h1", "h2").alias("who"), F.col("line").alias("lead_line"))
    near = earlier.join(own, ["h1", "h2"]).join(other, "who").filter(F.levenshtein("line", "lead_line", 1).between(0, 1))
    near = near.select("h1", "h2", F.lit(True).alias("near")).distinct()

    gone = firsts.join(near, ["h1", "h2"], "left").filter("times > 1 or near").select("h1", "h2", "first", "near")
    return lines.select("k", "rank", "no", "h1", "h2").join(gone, ["h1", "h2"]).filter(F.col("near") | (place > F.col("first"))).select("k", "rank", "no")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", near_chars: int = 16) -> DataFrame:
    """docs with text_col less its repeated lines, and n_lines and n_removed (columns of these names are replaced).

    Null text stays null with 0 lines; an empty text has one (blank) line. Null ids come last in the order. Rows of equal id
    and text count as one document and keep the same lines.
    """
    gone = removed_lines(keyed(docs, id_col, text_col), near_chars).groupBy("k").agg(F.collect_set(F.struct("rank", "no")).alias("gone"))
    text, number = F.col(text_col).cast("string"), F.col(id_col).cast("long")
    key = F.xxhash64(number, F.coalesce(text, F.lit("")))
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    # working columns get names that no column of docs has
    work = "_" * (1 + max(len(c) for c in docs.columns))
    wide = docs.select(*names).withColumn(work + "k", key).withColumn(work + "rank", F.coalesce(number, F.lit((1 << 63) - 1)))
    joined = wide.join(gone.select(F.col("k").alias(work + "k"), F.col("gone").alias(work + "gone")), work + "k", "left")
    mine = F.transform(F.filter(F.col(work + "gone"), lambda x: x["rank"] == F.col(work + "rank")), lambda x: x["no"])
    joined = joined.withColumn(work + "mine", F.coalesce(mine, F.array().cast("array<int>"))).withColumn(work + "lines", F.split(text, "\n", -1))
    kept = F.when(F.size(work + "mine") == 0, text).otherwise(F.array_join(F.filter(work + "lines", lambda x, i: ~F.array_contains(work + "mine", i)), "\n"))
    out = [kept.alias(c) if c == text_col else F.col(c) for c in names]
    return joined.select(*out, F.when(text.isNull(), 0).otherwise(F.size(work + "lines")).cast("long").alias("n_lines"), F.size(work + "mine").cast("long").alias("n_removed"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", "n_lines", "n_removed", F.length(text).cast("long").alias("n_chars_kept"), F.sha2(text, 256).alias("kept_sha256"))


SQL = """
WITH lines AS (
  SELECT doc_id, no, string_split(text, chr(10))[no + 1] AS line
  FROM (SELECT doc_id, text, unnest(range(0, len(string_split(text, chr(10))))) AS no FROM documents WHERE text IS NOT NULL)
), firsts AS (
  SELECT line, min((doc_id, no)) AS first, length(line) AS n, length(line) // 2 AS m
  FROM lines WHERE trim(line, ' ') <> '' GROUP BY line
), framed AS (
  SELECT line, first, n, f, f // 2 AS m FROM (SELECT line, first, n, unnest([n, n + 1]) AS f FROM firsts WHERE n >= 16)
), pairs AS (
  SELECT a.line AS line, b.line AS other, a.n AS n, b.n AS o, a.f AS f
  FROM framed a JOIN framed b ON a.f = b.f AND left(a.line, a.m) = left(b.line, b.m) WHERE b.first < a.first
  UNION
  SELECT a.line, b.line, a.n, b.n, a.f
  FROM framed a JOIN framed b ON a.f = b.f AND right(a.line, a.f - a.m) = right(b.line, b.f - b.m) WHERE b.first < a.first
), near AS (
  SELECT DISTINCT line FROM pairs
  WHERE abs(n - o) <= 1 AND len(list_filter(range(0, greatest(n, o)), lambda i: left(line, i) = left(other, i) AND
    CASE WHEN n = o THEN substring(line, i + 2) = substring(other, i + 2)
         WHEN n > o THEN substring(line, i + 2) = substring(other, i + 1)
         ELSE substring(line, i + 1) = substring(other, i + 2) END)) > 0
), marked AS (
  SELECT l.doc_id, l.no, l.line, coalesce(trim(l.line, ' ') <> '' AND ((l.doc_id, l.no) > f.first OR x.line IS NOT NULL), false) AS gone
  FROM lines l LEFT JOIN firsts f ON l.line = f.line LEFT JOIN near x ON l.line = x.line
), kept AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
    coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (WHERE NOT gone), '') AS text
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed,
  length(coalesce(k.text, '')) AS n_chars_kept, sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
