"""N-gram Jaccard join by vertical partitioning.

A document is the set of its word n-grams (lower-cased A-Z). Two link at a Jaccard similarity of at least
``percent`` / 100. The global order of n-grams (by hash) is cut into fragments.

1. Each fragment counts, for each document, the n-grams that any other document has too. The sums
   over fragments bound what a document can share; those that can't reach the threshold are done.
2. Of equal sets one stays. Of the remaining sets, n-grams are ordered from rare to frequent, and linked
   sets must share one within their prefixes.
3. Candidate pairs are compared in fragments of the order, each counting its partial overlap, and the
   partial overlaps are summed per pair. To find classes it isn't needed to compare all pairs of a
   large group: in rounds, sets first meet the most central members of other classes in their prefix
   n-grams' groups. When such rounds find little more, the pairs that are still in different classes are
   joined, block by block, under bounds from positions and parities that no link exceeds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from buildtrail.llm import textnp as tn
from buildtrail.llm.components import FEW, connected_components
from buildtrail.llm.keys import LAST, ident, keyed
from buildtrail.llm.session import checkpointed
from buildtrail.ship import ship

FRAGMENTS, PARITIES, STARS, BLOCK = 4, 1024, 3, 2000
HELD, FRAGMENT_SIZE = 1 << 19, 1 << 21  # n-grams that a task holds before it sends them; n-grams of a fragment
BROADCAST_ROWS, BROADCAST_SETS = 500_000, 50_000  # 24 bytes a row; 200 bytes a set (its parity, or its class)


def shingle_sets(buf: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of each text, sorted within it, and the texts' offsets into them."""
    _, _, h, wo = tn.words(tn.lower_ascii(buf), offs)
    size = np.diff(wo)
    g = tn.grams(h, n)
    count = np.maximum(size - n + 1, 0)
    doc = np.repeat(np.arange(len(size)), count)
    hashes = g[np.repeat(wo[:-1], count) + tn.spread(count)] if len(doc) else np.zeros(0, np.uint64)
    few = np.flatnonzero((size > 0) & (size < n))
    if len(few):
        whole = np.array([tn.grams(h[wo[i] : wo[i + 1]], int(size[i]))[0] for i in few], np.uint64)
        doc, hashes = np.concatenate([doc, few]), np.concatenate([hashes, tn.mix(whole + np.uint64(1))])
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    if len(doc):
        new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])])
        doc, hashes = doc[new], hashes[new]
    return hashes, np.searchsorted(doc, np.arange(len(size) + 1))


def _sets(texts: DataFrame, n: int) -> DataFrame:
    """(k, rank, n, s1, s2): size and a 128-bit sum of each text's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = tn.flat(batch.column(2))
            for i, j in tn.chunks(offs):
                h, ho = shingle_sets(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i], n)
                sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(tn.mix(h + np.uint64(x)))]) for x in (3, 4)]
                s1, s2 = ((s[ho[1:]] - s[ho[:-1]]).view(np.int64) for s in sums)
                yield pa.RecordBatch.from_pydict({"k": batch.column(0).slice(i, j - i), "rank": batch.column(1).slice(i, j - i), "n": pa.array(np.diff(ho), pa.int64()), "s1": pa.array(s1), "s2": pa.array(s2)})

    return texts.mapInArrow(run, "k long, rank long, n long, s1 long, s2 long")


def _shared(texts: DataFrame, n: int, total: int) -> DataFrame:
    """(k, shared): how many n-grams of each text stand in another text, or a few more; texts without any have no row.

    A task sends an n-gram that several of its texts have only once, so frequent n-grams cost a fragment little.
    total: n-grams of all texts, from which the number of fragments follows.
    """
    fragments = max(32, -(-total // FRAGMENT_SIZE))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ks = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            buf, offs = tn.flat(batch.column(1))
            held: list[tuple[np.ndarray, np.ndarray]] = []
            size = 0
            for i, j in tn.chunks(offs):
                h, ho = shingle_sets(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i], n)
                held.append((h, np.repeat(np.arange(i, j), np.diff(ho))))
                size += len(h)
                if size > HELD or j == len(offs) - 1:
                    yield from out(ks, np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]))
                    held, size = [], 0

    def out(ks: np.ndarray, h: np.ndarray, doc: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.argsort(h, kind="stable")
        h, doc = h[order], doc[order]
        new = np.concatenate([[True], h[1:] != h[:-1]])[: len(h)]
        group = np.cumsum(new) - 1
        many = np.bincount(group)[group] > 1 if len(group) else new
        shards, rows = [], []
        local = np.bincount(doc[many], minlength=len(ks))
        at = np.flatnonzero(local)
        if len(at):
            shards.append(-1 - int(ks[at[0]] % fragments))
            rows.append(np.int64(len(at)).tobytes() + ks[at].tobytes() + local[at].astype(np.int64).tobytes())
        h, doc, many = h[new], doc[new], many[new]
        fragment = ((h >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32)).astype(np.int64)
        cut = np.searchsorted(fragment, np.arange(fragments + 1))
        for f in np.flatnonzero(np.diff(cut)):
            a, b = cut[f], cut[f + 1]
            key = doc[a:b] * 2 + many[a:b]
            o = np.argsort(key, kind="stable")
            key, start = np.unique(key[o], return_index=True)
            count = np.diff(np.concatenate([start, [b - a]]))
            # as the range is known, 32 of the bits below its leading ones are enough for a bound
            short = (h[a:b] >> np.uint64(16)).astype(np.uint32)[o]
            sign = np.where(key % 2 == 1, -1, 1)  # negative: counted by this task already
            shards.append(int(f))
            rows.append(np.int64(len(key)).tobytes() + ks[key // 2].tobytes() + (sign * count).astype(np.int32).tobytes() + short.tobytes())
        yield pa.RecordBatch.from_pydict({"fragment": pa.array(shards, pa.int32()), "rows": pa.array(rows, pa.binary())})

    def meet(table: pa.Table) -> pa.Table:
        ks, counts, shorts = [], [], []
        local = table.column("fragment")[0].as_py() < 0
        for x in table.column("rows"):
            blob = x.as_py()
            m = int(np.frombuffer(blob, np.int64, 1)[0])
            ks.append(np.frombuffer(blob, np.int64, m, 8))
            if local:
                counts.append(np.frombuffer(blob, np.int64, m, 8 + 8 * m))
            else:
                counts.append(np.frombuffer(blob, np.int32, m, 8 + 8 * m))
                shorts.append(np.frombuffer(blob, np.uint32, -1, 8 + 12 * m))
        k, count = np.concatenate(ks), np.concatenate(counts)
        if local:
            return pa.table({"k": k, "shared": count})
        short = np.concatenate(shorts)
        owner = np.repeat(np.arange(len(k)), np.abs(count))
        order = np.argsort(short, kind="stable")
        short, owner = short[order], owner[order]
        same = short[1:] == short[:-1]
        hit = (np.concatenate([[False], same]) | np.concatenate([same, [False]])) & (count[owner] > 0)
        n_hit = np.bincount(owner[hit], minlength=len(k))
        at = np.flatnonzero(n_hit)
        return pa.table({"k": k[at], "shared": n_hit[at].astype(np.int64)})

    sent = texts.select("k", "text").mapInArrow(send, "fragment int, rows binary")
    return sent.groupBy("fragment").applyInArrow(meet, "k long, shared long").groupBy("k").agg(F.sum("shared").alias("shared"))


def _tokens(texts: DataFrame, n: int) -> DataFrame:
    """(node struct<rank,k>, n, f, part array<long>, parity array<long>): the sets in fragments of the n-gram order.

    parity (with fragment 0 alone) has a bit for each of PARITIES parts: whether an odd number of n-grams fall in it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = tn.flat(batch.column(2))
            for i, j in tn.chunks(offs):
                h, ho = shingle_sets(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i], n)
                doc = np.repeat(np.arange(j - i), np.diff(ho))
                cut = np.searchsorted(doc * FRAGMENTS + (h >> np.uint64(62)).astype(np.int64), np.arange((j - i) * FRAGMENTS + 1))
                at = pa.array(np.repeat(np.arange(j - i), FRAGMENTS))
                part = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(h.view(np.int64)))
                times = np.zeros((j - i, PARITIES), np.uint8)
                np.add.at(times, (doc, (h % np.uint64(PARITIES)).astype(np.int64)), 1)
                bits = np.packbits(times & 1, axis=1).view(np.int64)
                has = np.tile(np.arange(FRAGMENTS) == 0, j - i)
                stop = np.concatenate([[0], np.cumsum(has * bits.shape[1])])
                parity = pa.ListArray.from_arrays(pa.array(stop, pa.int32()), pa.array(bits.ravel()))
                yield pa.RecordBatch.from_pydict(
                    {
                        "k": batch.column(0).slice(i, j - i).take(at),
                        "rank": batch.column(1).slice(i, j - i).take(at),
                        "n": pa.array(np.repeat(np.diff(ho), FRAGMENTS), pa.int64()),
                        "f": pa.array(np.tile(np.arange(FRAGMENTS), j - i), pa.int32()),
                        "part": part,
                        "parity": parity,
                    }
                )

    rows = texts.mapInArrow(run, "k long, rank long, n long, f int, part array<long>, parity array<long>")
    return rows.select(F.struct("rank", "k").alias("node"), "n", "f", "part", "parity")


def least_overlap(n: Column, percent: int) -> Column:
    """The least overlap that a set of n elements needs with any set it links to."""
    return F.ceil(n * percent / 100.0 - 1e-9).cast("long")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, na, nb) whose partial overlaps sum to enough."""
    sides = pairs.select("*", F.explode(F.array("a", "b")).alias("node"))
    parts = sides.join(sets.select("node", "f", "part"), "node").repartition(F.col("a"), F.col("b"))
    met = parts.groupBy("a", "b", "na", "nb", "f").agg(F.max_by("part", "node").alias("x"), F.min_by("part", "node").alias("y"))
    partial = met.select("a", "b", "na", "nb", F.size(F.array_intersect("x", "y")).alias("part"))
    total = partial.groupBy("a", "b", "na", "nb").agg(F.sum("part").alias("both"))
    return total.filter(F.col("both") * 100 >= (F.col("na") + F.col("nb") - F.col("both")) * percent)


def _may_link(na: Column, nb: Column, bound: Column, percent: int) -> Column:
    """Whether sets of these sizes can link when they share at most ``bound`` n-grams."""
    return bound * (100 + percent) >= (na + nb) * percent


def _alike(na: Column, nb: Column, x: Column, y: Column, percent: int) -> Column:
    """Whether two sets' parities leave a link open. A part's parity differs only if the sets differ in it."""
    differ = F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda a, v: a + v)
    return differ * (100 + percent) <= (na + nb) * (100 - percent)


def _prefixes(posts: DataFrame, percent: int) -> DataFrame:
    """posts (gram, node, n) -> the prefix n-grams, with common (how many n-grams another set has too), nth of them by rarity, and central."""
    by_node = Window.partitionBy("node")
    posts = posts.withColumn("df", F.count("*").over(Window.partitionBy("gram"))).filter("df > 1")
    posts = posts.withColumn("common", F.count("*").over(by_node)).withColumn("central", F.sum("df").over(by_node) / F.col("n"))
    posts = posts.withColumn("nth", F.row_number().over(by_node.orderBy("df", "gram")))
    return posts.filter(F.col("nth") <= F.col("common") - least_overlap(F.col("n"), percent) + 1).drop("df")


def _mixed(prefix: DataFrame, found: DataFrame | None) -> DataFrame:
    """The rows of prefix whose n-gram sets of several classes have, with their class (root)."""
    if found is None:
        return prefix.withColumn("root", F.col("node"))
    placed = prefix.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    many = placed.groupBy("gram").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("gram")
    return placed.join(many, "gram")


def _stars(prefix: DataFrame, percent: int) -> DataFrame:
    """A few likely pairs (a, b, na, nb) for each set: with the sets in the middle of most of its n-grams' groups.

    Each n-gram offers its most central set and the most central one of any other class.
    """
    own = F.struct("central", "root", "node", "n", "common")
    one = prefix.groupBy("gram").agg(F.max(own).alias("one"))
    two = prefix.join(one, "gram").filter(F.col("root") != F.col("one.root")).groupBy("gram").agg(F.max(own).alias("two"), F.first("one").alias("one"))
    met = prefix.join(two, "gram").withColumn("met", F.when(F.col("root") != F.col("one.root"), F.col("one")).otherwise(F.col("two")))
    met = met.filter(_may_link(F.col("n"), F.col("met.n"), F.least("common", "met.common"), percent))
    met = met.repartition(F.col("node")).groupBy("node", "n", "met").agg(F.count("*").alias("times"))
    order = Window.partitionBy("node").orderBy(F.desc("times"), F.desc("met"))
    met = met.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= STARS)
    x, y = F.struct("node", "n"), F.struct(F.col("met.node").alias("node"), F.col("met.n").alias("n"))
    low, high = F.least(x, y), F.greatest(x, y)
    return met.select(low["node"].alias("a"), high["node"].alias("b"), low["n"].alias("na"), high["n"].alias("nb")).distinct()


def _across(prefix: DataFrame, parities: DataFrame, percent: int) -> DataFrame:
    """All pairs (a, b, na, nb) of different classes that share a prefix n-gram, but for those that can't link.

    Sets of an n-gram's group meet block by block; what comes out of the join has passed every bound.
    """
    size = prefix.groupBy("gram").agg(F.count("*").alias("many"))
    rows = prefix.join(size, "gram").join(parities, "node").withColumn("blocks", F.ceil(F.col("many") / BLOCK).cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    kept = ["node", "n", "root", "common", "nth", "parity"]
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    left = rows.select("gram", F.col("own").alias("i"), other, *(F.col(c).alias(f"{c}_a") for c in kept)).withColumnRenamed("other", "j")
    right = rows.select("gram", F.col("own").alias("j"), other, *(F.col(c).alias(f"{c}_b") for c in kept)).withColumnRenamed("other", "i")
    na, nb = F.col("n_a"), F.col("n_b")
    bound = F.least("nth_a", "nth_b") + F.least(F.col("common_a") - F.col("nth_a"), F.col("common_b") - F.col("nth_b"))
    same = (left["gram"] == right["gram"]) & (left["i"] == right["i"]) & (left["j"] == right["j"])
    open_ = (F.col("node_a") < F.col("node_b")) & (F.col("root_a") != F.col("root_b")) & _may_link(na, nb, bound, percent) & _alike(na, nb, F.col("parity_a"), F.col("parity_b"), percent)
    return left.join(right, same & open_).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"), na.alias("na"), nb.alias("nb")).distinct()


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 75) -> DataFrame:
    """(k, rank, n, root): each row's set size and the least (rank, k) reachable by links; a text without words is alone.

    Null ids count as the largest; rows of one id are told apart by their text.
    """
    ship(docs.sparkSession)
    texts = keyed(docs, id_col, text_col)
    meta = checkpointed(_sets(texts, n))
    full = meta.filter("n > 0")
    total = meta.agg(F.sum("n")).first()[0] or 0
    reps = full.groupBy("s1", "s2", "n").agg(F.min(F.struct("rank", "k")).alias("rep"))
    able = _shared(texts, n, total).join(reps.select(F.col("rep.k").alias("k"), F.col("rep.rank").alias("rank"), "n"), "k")
    able = checkpointed(able.filter(F.col("shared") >= least_overlap(F.col("n"), percent)).select("k", "rank"))
    small = able.count() <= BROADCAST_ROWS
    sets = checkpointed(_tokens(texts.join(F.broadcast(able) if small else able, ["k", "rank"], "left_semi").dropDuplicates(["k", "rank"]), n))
    roots = connected_components(_links(sets, percent))

    of_rep = reps.join(roots, F.col("rep") == F.col("node"), "left").select("s1", "s2", "n", F.coalesce("root", "rep").alias("root"))
    return full.join(of_rep, ["s1", "s2", "n"]).select("k", "rank", "n", "root").unionByName(meta.filter("n = 0").select("k", "rank", "n", F.struct("rank", "k").alias("root")))


def _links(sets: DataFrame, percent: int) -> DataFrame:
    """(u, v): links that connect all sets which any links connect.

    Rounds of stars go on while one adds a tenth to the links of all before; what they leave apart is compared across classes.
    """
    parities = sets.filter("f = 0").select("node", "parity")
    few = parities.count() <= BROADCAST_SETS
    near = F.broadcast if few else lambda df: df
    dealt = (lambda df: df.coalesce(FEW)) if few else (lambda df: df)  # pairs of a few sets need few tasks
    parities = near(parities)
    prefix = checkpointed(_prefixes(sets.select("node", "n", F.explode("part").alias("gram")), percent))
    x = parities.select(F.col("node").alias("a"), F.col("parity").alias("pa"))
    y = parities.select(F.col("node").alias("b"), F.col("parity").alias("pb"))
    alike = _alike(F.col("na"), F.col("nb"), F.col("pa"), F.col("pb"), percent)
    links, found, before = None, None, 0
    while True:
        likely = _stars(_mixed(prefix, found), percent).join(x, "a").join(y, "b").filter(alike).select("a", "b", "na", "nb")
        more = _linked(dealt(likely), sets, percent).select(F.col("a").alias("u"), F.col("b").alias("v"))
        more = dealt(more)
        links = checkpointed(more if links is None else links.unionByName(more))
        total = links.count()
        if total - before <= before / 10:
            break
        before, found = total, near(connected_components(links))
    rest = _linked(dealt(_across(_mixed(prefix, found), parities, percent)), sets, percent)
    return links.unionByName(rest.select(F.col("a").alias("u"), F.col("b").alias("v")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    root = F.when(F.col("root.rank") != LAST, F.col("root.rank"))
    return found.select(ident().alias("doc_id"), F.col("n").alias("n_shingles"), root.alias("component_id"))
