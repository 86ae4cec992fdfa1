"""Output of attempts: chunks (node, gen, stream, seq, data binary), in order of seq, then stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def newest_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks of each node's newest gen, each (stream, seq) once."""
    top = chunks.groupBy("node").agg(F.max("gen").alias("__top"))
    return chunks.join(top, "node").filter("gen = __top").drop("__top").dropDuplicates(["node", "stream", "seq"])


def log_view(chunks: DataFrame, head: int, tail: int) -> DataFrame:
    """(node, gen, head, gap, tail): first bytes, last bytes of the rest, and how many were between.

    Chunks that lie wholly between are dropped by running sums before anything is gathered.
    """
    order = Window.partitionBy("node").orderBy("seq", "stream")
    size = F.octet_length("data")
    rows = newest_chunks(chunks).withColumn("end", F.sum(size).over(order)).withColumn("total", F.sum(size).over(Window.partitionBy("node")))
    rows = rows.withColumn("start", F.col("end") - size)
    tail_from = F.greatest(F.lit(head), F.col("total") - tail)
    piece = lambda low, high: F.substring("data", F.greatest(low - F.col("start"), F.lit(0)).cast("int") + 1, F.greatest(F.least(high, F.col("end")) - F.greatest(low, F.col("start")), F.lit(0)).cast("int"))
    rows = rows.filter((F.col("start") < head) | (F.col("end") > tail_from))
    cut = rows.select("node", "gen", "seq", "stream", "total", piece(F.lit(0), F.lit(head)).alias("h"), piece(tail_from, F.col("total")).alias("t"))
    got = cut.groupBy("node", "gen", "total").agg(F.sort_array(F.collect_list(F.struct("seq", "stream", "h", "t"))).alias("p"))
    join = lambda c: F.aggregate(F.transform("p", lambda x: x[c]), F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x))
    return got.select("node", "gen", join("h").alias("head"), F.greatest(F.lit(0), F.col("total") - head - tail).alias("gap"), join("t").alias("tail"))


def cap_output(chunks: DataFrame, cap: int) -> DataFrame:
    """(node, gen, stream, seq, offset, data): each stream cut at cap bytes, chunks beyond it dropped, ``truncated`` on the last."""
    w = Window.partitionBy("node", "gen", "stream").orderBy("seq")
    rows = chunks.withColumn("offset", F.sum(F.octet_length("data")).over(w) - F.octet_length("data"))
    room = F.greatest(F.lit(0), cap - F.col("offset"))
    out = rows.withColumn("truncated", F.octet_length("data") > room).withColumn("data", F.substring("data", F.lit(1), F.least(F.octet_length("data"), room).cast("int")))
    return out.filter(F.col("offset") < cap)


def truncation_marks(chunks: DataFrame, cap: int) -> DataFrame:
    """(node, gen, stream, seq, cap, written): one row for each stream of over cap bytes, at the chunk that crossed it; written is all that was written to it."""
    w = Window.partitionBy("node", "gen", "stream").orderBy("seq")
    rows = chunks.withColumn("__end", F.sum(F.octet_length("data")).over(w))
    out = rows.groupBy("node", "gen", "stream").agg(F.min(F.when(F.col("__end") > cap, F.col("seq"))).alias("seq"), F.max("__end").alias("written"))
    return out.filter("seq is not null").select("node", "gen", "stream", "seq", F.lit(cap).cast("long").alias("cap"), "written")


def retry_marks(chunks: DataFrame) -> DataFrame:
    """Where a newer gen's first chunk comes after older ones in arrival order (seq); chunks of older gens are left out."""
    w = Window.partitionBy("node").orderBy("seq", "stream")
    top = F.max("gen").over(w)
    rows = chunks.withColumn("__top", top).filter("gen = __top").drop("__top")
    prev = F.lag("gen").over(w)
    return rows.withColumn("mark", prev.isNotNull() & (F.col("gen") > prev))


def log_lines(chunks: DataFrame, prefix: str = "") -> DataFrame:
    """(node, gen, stream, no, line): a stream's chunks split at newlines, in order of seq, lines put together across chunk borders.

    Only the first and last piece of each chunk are gathered, by the number of their line; whole lines in between pass as they are, so
    no row holds more than a line. Bytes are joined before they are read as text, closing carriage returns are trimmed, a last
    partial line is kept, prefix stands before each line. Null data counts as empty.
    """
    keys = ["node", "gen", "stream"]
    bytewise = F.decode(F.coalesce(F.col("data").cast("binary"), F.lit(b"")), "ISO-8859-1")  # a character a byte
    rows = chunks.select(*keys, "seq", F.split(bytewise, "\n", -1).alias("p")).withColumn("n", (F.size("p") - 1).cast("long"))
    own = Window.partitionBy(*keys)
    rows = rows.withColumn("no", F.sum("n").over(own.orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).withColumn("all", F.sum("n").over(own))
    inner = rows.filter("n > 1").select(*keys, "no", "all", F.posexplode(F.expr("slice(p, 2, size(p) - 2)")).alias("i", "line")).select(*keys, "all", (F.col("no") + F.col("i") + 1).alias("no"), "line")
    ends = F.array(F.struct(F.col("no"), F.element_at("p", 1).alias("piece")), F.when(F.col("n") > 0, F.struct((F.col("no") + F.col("n")).alias("no"), F.element_at("p", -1).alias("piece"))))
    border = rows.select(*keys, "all", "seq", F.explode(ends).alias("e")).filter("e is not null").select(*keys, "all", "seq", "e.*")
    joined = border.groupBy(*keys, "all", "no").agg(F.expr("array_join(transform(array_sort(collect_list(struct(seq, piece))), x -> x.piece), '')").alias("line"))
    text = F.encode("line", "ISO-8859-1").cast("string")
    lines = inner.unionByName(joined).filter("no < all or line <> ''")
    return lines.select(*keys, F.col("no").cast("int").alias("no"), F.concat(F.lit(prefix), F.regexp_replace(text, "\r+$", "")).alias("line"))


def rechunk_bytes(chunks: DataFrame, size: int = 32 << 10) -> DataFrame:
    """(node, gen, stream, offset, data): the same bytes in chunks of size, the last one of a stream shorter; empty streams have none."""
    keys = ["node", "gen", "stream"]
    data = F.coalesce(F.col("data").cast("binary"), F.lit(b""))
    rows = chunks.select(*keys, "seq", data.alias("data")).withColumn("n", F.octet_length("data").cast("long"))
    rows = rows.withColumn("at", F.sum("n").over(Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).filter("n > 0")
    cut = rows.withColumn("bucket", F.explode(F.expr(f"sequence(at div {size}, (at + n - 1) div {size})"))).withColumn("low", F.expr(f"greatest(bucket * {size} - at, 0)"))
    piece = F.expr(f"hex(substring(data, cast(low + 1 AS int), cast(least((bucket + 1) * {size} - at, n) - low AS int)))")  # as text, which joins in linear time
    parts = cut.select(*keys, "bucket", (F.col("at") + F.col("low")).alias("at"), piece.alias("piece")).groupBy(*keys, "bucket").agg(F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("p"))
    return parts.select(*keys, (F.col("bucket") * size).alias("offset"), F.unhex(F.expr("array_join(transform(p, x -> x.piece), '')")).alias("data"))


def rechunk(chunks: DataFrame, size: int) -> DataFrame:
    """(node, gen, stream, bucket, chunks, bytes): small chunks gathered to buckets of about ``size`` bytes by their offset."""
    w = Window.partitionBy("node", "gen", "stream").orderBy("seq")
    rows = chunks.withColumn("offset", F.sum(F.octet_length("data")).over(w) - F.octet_length("data"))
    return rows.groupBy("node", "gen", "stream", F.floor(F.col("offset") / size).alias("bucket")).agg(F.count("*").alias("chunks"), F.sum(F.octet_length("data")).alias("bytes"))
