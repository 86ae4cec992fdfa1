"""Shards that all hold the mixture of sources, by proportional stratified interleaving, with DataFrame functions only.

The rows of each source are put in a seeded random order. The row of rank r in a source of n rows gets the fractional
rank (r + u) / n, where u in (0, 1) is the source's own seeded phase, so that sources of one row spread out as well. All
rows sorted by fractional rank are cut into runs whose lengths are at most one apart: the shards. Every source is spread
evenly over that order, so each shard holds its share of each source.

No source and no shard is ranked in one task. The random order of a source is cut into buckets by the leading bits of its
keys, and the order of fractional ranks, which is near uniform, into cells; counts of buckets and cells give each its first
rank, and rows are numbered within them. Fully repeated rows are one row with a count until they have their ranks. Texts
are read once; what is shuffled is a key, an id, a size and a checksum a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from buildtrail.llm.session import checkpointed
from buildtrail.ship import shuffle_partitions

SEED = "interleave-1"
ROWS = 20_000  # aimed at in a bucket or cell
COPIES = 10_000  # of a repeated row that one task writes out
BITS = 28


def _lead(digest: Column) -> Column:
    """The first 28 bits of a hexadecimal digest."""
    return F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("long")


def _keys(docs: DataFrame, id_col: str, text_col: str, source_col: str | None, seed: str) -> tuple[Column, Column, Column, Column]:
    """Id, text, stratum and the key of a row's place in its stratum's random order."""
    number, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    source = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("null")) if source_col else F.lit("all")
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(number.cast("string"), F.lit("")), F.lit(":"), text).cast("binary"))
    return number, text, F.md5(F.concat(F.lit(f"{seed}:"), source).cast("binary")), key


def assign(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", source_col: str | None = "source", seed: str = SEED) -> DataFrame:
    """A row for each row of docs: id_col, size, text_crc32, stratum, key, shard, slot.

    size: bytes of the text as UTF-8, and 8. shard: 0 to shards - 1, counts at most one apart; with fewer rows than shards
    some stay empty. slot: gapless from 0 in each shard, in the order of fractional ranks. A null text counts as empty, a
    null source is a source of its own, null and repeated ids are kept. Repeated rows each get a slot. Further columns are
    ignored, whatever their names. An empty table gives no rows. Equal texts are not kept together: this method spreads
    rows by source alone.
    """
    number, text, stratum, key = _keys(docs, id_col, text_col, source_col, seed)
    read = docs.select(number.alias("id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"), stratum.alias("stratum"), key.alias("key"))
    rows = checkpointed(read.groupBy("id", "size", "crc", "stratum", "key").agg(F.count("*").alias("copies")))
    total = int(rows.agg(F.sum("copies")).first()[0] or 0)
    parts = max(-(-total // ROWS), shuffle_partitions(docs.sparkSession))

    # ranks within each stratum
    placed = rows.withColumn("bucket", F.floor(_lead(F.col("key")) * parts / (1 << BITS)))
    counts = placed.groupBy("stratum", "bucket").agg(F.sum("copies").alias("n"))
    upto = Window.partitionBy("stratum").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("stratum", "bucket", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("first"), F.sum("n").over(Window.partitionBy("stratum")).alias("n"))
    within = Window.partitionBy("stratum", "bucket").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    ranked = placed.join(firsts, ["stratum", "bucket"]).withColumn("rank", F.col("first") + F.coalesce(F.sum("copies").over(within), F.lit(0)))

    # one row a copy again
    columns = ["id", "size", "crc", "stratum", "key", "n"]
    single = ranked.filter("copies = 1").select(*columns, "rank")
    many = ranked.filter("copies > 1").withColumn("from", F.explode(F.expr(f"sequence(0L, copies - 1, {COPIES}L)")))
    many = many.repartition("key", "from").withColumn("at", F.explode(F.expr(f"sequence(from, least(from + {COPIES}L, copies) - 1)")))
    each = single.unionByName(many.select(*columns, (F.col("rank") + F.col("at")).alias("rank")))

    # ranks in the order of fractional ranks
    phase = (_lead(F.col("stratum")) + 0.5) / float(1 << BITS)
    spread = each.withColumn("fraction", (F.col("rank") + phase) / F.col("n")).withColumn("cell", F.floor(F.col("fraction") * parts))
    sizes = spread.groupBy("cell").agg(F.count("*").alias("n"))
    cells = sizes.select("cell", F.coalesce(F.sum("n").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))  # a row for each 20,000 rows
    order = Window.partitionBy("cell").orderBy("fraction", "stratum", "rank")
    place = F.col("first") + F.row_number().over(order) - 1
    # in whole numbers: the first place of shard s is ceil(s * total / shards)
    done = spread.join(cells, "cell").withColumn("place", place)
    shard = F.expr(f"cast((place * {shards}L) div {max(total, 1)}L as int)")
    done = done.withColumn("shard", shard)
    begin = F.expr(f"(shard * {total}L + {shards - 1}L) div {shards}L")
    return done.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "stratum", "key", "shard", (F.col("place") - begin).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", source_col: str | None = "source", seed: str = SEED, rows_a_file: int = 100_000) -> None:
    """Write (id_col, text_col[, source_col], slot) to path as Parquet, a folder ``shard=N`` each, files in order of slots."""
    number, text, stratum, key = _keys(docs, id_col, text_col, source_col, seed)
    names = [id_col, text_col, *([source_col] if source_col else [])]
    once = docs.select(*names, stratum.alias("stratum"), key.alias("key")).dropDuplicates(["stratum", "key"])
    slots = assign(docs, shards, id_col, text_col, source_col, seed).select("stratum", "key", "shard", "slot")
    held = slots.join(once, ["stratum", "key"]).withColumn("file", F.floor(F.col("slot") / rows_a_file))
    held.repartition("shard", "file").sortWithinPartitions("shard", "slot").select(*names, "slot", "shard").write.partitionBy("shard").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = assign(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


# A checksum of UTF-8 bytes: the table of the reversed polynomial 0xEDB88320 by its rule, then one lookup a byte.
CRC_TABLE = """
  SELECT list(list_reduce([v, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY v) AS crc_table
  FROM (SELECT unnest(range(0, 256)) AS v)
"""


def crc_sql(text: str) -> str:
    """SQL for the unsigned CRC-32 of a text; a column crc_table must be at hand."""
    digits = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda d: (instr('0123456789ABCDEF', d[1]) - 1) * 16 + instr('0123456789ABCDEF', d[2]) - 1)"
    return f"xor(list_reduce(list_prepend(4294967295, {digits}), lambda c, b: xor(c >> 8, crc_table[xor(c & 255, b) + 1])), 4294967295)"


SQL = f"""
WITH crcs AS ({CRC_TABLE}),
docs AS (
  SELECT doc_id, coalesce(text, '') AS text, md5('{SEED}:' || coalesce('=' || source, 'null')) AS stratum,
    md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS key
  FROM documents
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY key) - 1 AS rank, count(*) OVER (PARTITION BY stratum) AS n FROM docs
), placed AS (
  SELECT *, row_number() OVER (ORDER BY (rank + (CAST('0x' || left(stratum, 7) AS BIGINT) + 0.5::DOUBLE) / 268435456::DOUBLE) / n::DOUBLE, stratum, rank) - 1 AS place,
    count(*) OVER () AS total
  FROM ranked
), cut AS (
  SELECT *, (place * 24) // total AS shard FROM placed
)
SELECT doc_id, CAST(octet_length(encode(text)) + 8 AS BIGINT) AS size, CAST({crc_sql("text")} AS BIGINT) AS text_crc32, 'rows' AS law,
  CAST(shard AS INTEGER) AS shard, CAST(place - (shard * total + 23) // 24 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM cut, crcs
"""
