"""Spelling variants: words of a corpus within one edit of each other, found by Bloom-guided neighbourhoods.

The vocabulary is counted over whole texts. Its words are put into blocked Bloom filters, one for each word length, or several
for a length of many words. Filters are sent to the tasks in groups of at most ``FILTER_BYTES``; a vocabulary with more of
them takes one pass a group. Every word is probed with its edits: all deletions of a code point against the filters of
one length less, all replacements against its own length. An insertion is the other word's deletion, so
each near pair is met. Only edits that a filter may hold become rows; an exact join with the vocabulary drops those that
it doesn't hold.

An edit's hash comes from sums before and behind its place, so edits of a word of L code points take time and space
in proportion to L, however long the word is.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buildtrail.llm.session import checkpointed
from buildtrail.llm.sharding import CRC_TABLE, crc_sql
from buildtrail.ship import ship

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
SLIP = 97  # one in so many runs of a document loses a code point
FILTER_BYTES = 32 << 20  # of filters sent to the tasks at a time
BITS_A_WORD, LANES = 16, 8  # a block is eight lanes of 32 bits
PIECE = 1 << 20  # code points of a text, or edits of words, that are worked on at once
HELD = 200_000  # distinct words that a task counts before it hands them on
BASE = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1


def slipped(doc_id: int | None, run: str) -> str:
    """The run, less one code point where the checksum of document and run says so."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % SLIP:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _runs(text: str) -> Iterator[list[str]]:
    """Lower-cased runs of a text, some at a time; a run is never cut."""
    at = 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and RUN.match(text, end - 1, end) and RUN.match(text, end, end + 1):
            end += 1
        yield RUN.findall(text[at:end].translate(LOWER))
        at = end


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 5, least_n: int = 3) -> DataFrame:
    """(word, n): words of at least least_chars code points that occur at least least_n times in all texts.

    Null texts have no words; a null id counts as an empty one; repeated rows count as often as they stand.
    """
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def emptied() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pydict({"word": pa.array(list(held), pa.string()), "n": pa.array(list(held.values()), pa.int64())})
            held.clear()
            return out

        for batch in batches:
            for number, text in zip(batch.column(0), batch.column(1), strict=True):
                own: Counter[str] = Counter()
                for runs in _runs(text.as_py()):
                    own.update(runs)
                for run, n in own.items():
                    if len(run) < least_chars:
                        continue
                    word = slipped(number.as_py(), run)
                    if len(word) >= least_chars:
                        held[word] += n
                if len(held) >= HELD:
                    yield emptied()
        if held:
            yield emptied()

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).filter("text is not null")
    counts = texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.filter(F.col("n") >= least_n)


# -- hashes of words and of their edits -------------------------------------------------------------------


def _mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _values(points: np.ndarray) -> np.ndarray:
    """A random number for each code point."""
    return _mixed(points.astype(np.uint64) * np.uint64(BASE) + np.uint64(1))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, np.uint64(BASE), np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def hashes(points: np.ndarray) -> np.ndarray:
    """Of words of one length, a row each: the sum of values times powers, modulo 2^64."""
    return (_values(points) * _powers(points.shape[1])).sum(1, dtype=np.uint64)


def _code_points(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)


class Filter:
    """A blocked Bloom filter over hashes: lanes (blocks, 8) of 32 bits, one bit of each lane a word."""

    SALTS = np.array([2654435769 + 2 * 1013904223 * k & 0xFFFFFFFF | 1 for k in range(LANES)], np.uint32)

    def __init__(self, lanes: np.ndarray):
        self.lanes = lanes

    @staticmethod
    def size(words: int) -> int:
        """Blocks for so many words."""
        return max(1, -(-words * BITS_A_WORD // (32 * LANES)))

    @staticmethod
    def places(h: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
        """Block of each hash, and 32 bits by which its bits in the lanes are chosen."""
        mixed = _mixed(h)
        return ((mixed >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64), (mixed & np.uint64(0xFFFFFFFF)).astype(np.uint32)

    @classmethod
    def bits(cls, low: np.ndarray, lane: int) -> np.ndarray:
        return np.uint32(1) << ((low * cls.SALTS[lane]) >> np.uint32(27))

    def may_hold(self, h: np.ndarray) -> np.ndarray:
        """Indices of the hashes that may be in the filter."""
        block, low = self.places(h, len(self.lanes))
        left = np.arange(len(h))
        for lane in range(LANES):
            hit = (self.lanes[block[left], lane] & self.bits(low[left], lane)) != 0
            left = left[hit]
        return left


def build_filters(words: DataFrame, sizes: dict[tuple[int, int], int], parts: dict[int, int]) -> dict[tuple[int, int], Filter]:
    """words: (word). The filters named in sizes ((length, part): words), made by Spark and gathered: at most FILTER_BYTES."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, group in _by_length(batch.column(0).to_pylist()):
                if length not in parts:
                    continue
                h = hashes(_code_points(group))
                part = _part(h, parts[length])
                for p in range(parts[length]):
                    mine = h[part == p]
                    if (length, p) not in sizes or not len(mine):
                        continue
                    block, low = Filter.places(mine, Filter.size(sizes[length, p]))
                    lanes = {f"b{k}": pa.array(Filter.bits(low, k).astype(np.int64)) for k in range(LANES)}
                    yield pa.RecordBatch.from_pydict({"length": pa.array(np.full(len(mine), length), pa.int64()), "part": pa.array(np.full(len(mine), p), pa.int64()), "block": pa.array(block)} | lanes)

    lanes = [f"b{k}" for k in range(LANES)]
    made = words.select("word").mapInArrow(place, "length long, part long, block long, " + ", ".join(f"{x} long" for x in lanes))
    blocks = made.groupBy("length", "part", "block").agg(*[F.bit_or(x).alias(x) for x in lanes]).toPandas()
    out = {}
    for key, n in sizes.items():
        table = np.zeros((Filter.size(n), LANES), np.uint32)
        mine = blocks[(blocks["length"] == key[0]) & (blocks["part"] == key[1])]
        table[mine["block"].to_numpy(np.int64)] = mine[lanes].to_numpy(np.int64).astype(np.uint32)
        out[key] = Filter(table)
    return out


def _part(h: np.ndarray, parts: int) -> np.ndarray:
    """Which filter of its length a hash belongs to."""
    return (_mixed(h ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(parts)).astype(np.int64)


def _by_length(words: list[str]) -> Iterator[tuple[int, list[str]]]:
    groups: dict[int, list[str]] = defaultdict(list)
    for w in words:
        groups[len(w)].append(w)
    yield from groups.items()


def edits(points: np.ndarray, alphabet: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The deletions and replacements of words of one length: (length, hash, word, place, code point, -1 for a deletion).

    Of equal neighbours only the last is deleted. Replacements go upwards only (each pair is met from its lesser word).
    At most about PIECE edits at a time.
    """
    m, n = points.shape
    powers, letters = _powers(n), _values(alphabet)
    inverse = np.uint64(pow(BASE, -1, 1 << 64))
    rows = max(1, PIECE // (n * (len(alphabet) + 1)))
    for a in range(0, m, rows):
        some = points[a : a + rows]
        terms = _values(some) * powers
        upto = np.cumsum(terms, axis=1, dtype=np.uint64)
        whole = upto[:, -1]
        w, at = np.nonzero(np.concatenate([some[:, 1:] != some[:, :-1], np.ones((len(some), 1), bool)], 1))
        yield n - 1, upto[w, at] - terms[w, at] + (whole[w] - upto[w, at]) * inverse, a + w, at, np.full(len(w), -1, np.int64)
        for b in range(0, n, max(1, PIECE // (len(alphabet) * len(some)))):
            e = min(n, b + max(1, PIECE // (len(alphabet) * len(some))))
            h = (whole[:, None] - terms[:, b:e])[:, :, None] + letters * powers[b:e, None]
            w, at, c = np.nonzero(alphabet[None, None, :] > some[:, b:e, None])
            yield n, h[w, at, c], a + w, b + at, alphabet[c].astype(np.int64)


def near_words(words: DataFrame) -> DataFrame:
    """words: (word, n), words distinct, written to disk. Returns (word, n, other, other_n): each ordered pair within one edit."""
    spark = words.sparkSession
    ship(spark)
    lengths = {r["length"]: r["n"] for r in words.groupBy(F.length("word").alias("length")).agg(F.count("*").alias("n")).collect()}  # a row a length
    used = words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).filter("c <> ''").distinct()
    alphabet = np.sort(np.array([ord(r["c"]) for r in used.collect()], np.uint32))  # code points of RUN, 116 at most
    most = FILTER_BYTES * 8 // BITS_A_WORD // 2  # words of one filter: half a group's room, as parts aren't quite even
    parts = {length: -(-n // most) for length, n in lengths.items()}
    cells = [(length, p) for length in sorted(lengths) for p in range(parts[length])]
    groups: list[dict[tuple[int, int], int]] = [{}]
    for length, p in cells:
        n = -(-lengths[length] // parts[length])
        if groups[-1] and sum(groups[-1].values()) + n > 2 * most:
            groups.append({})
        groups[-1][length, p] = n
    found = None
    for sizes in groups:
        if not sizes:
            continue
        filters = spark.sparkContext.broadcast({k: f.lanes for k, f in build_filters(words, sizes, parts).items()})

        def probe(batches: Iterator[pa.RecordBatch], filters=filters, sizes=sizes) -> Iterator[pa.RecordBatch]:
            held = {k: Filter(lanes) for k, lanes in filters.value.items()}
            for batch in batches:
                ns = dict(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
                for length, group in _by_length(list(ns)):
                    if not any(k[0] in (length, length - 1) for k in sizes):
                        continue
                    for goal, h, w, at, c in edits(_code_points(group), alphabet):
                        mine = [p for p in range(parts.get(goal, 0)) if (goal, p) in sizes]
                        for p in mine:
                            pick = np.flatnonzero(_part(h, parts[goal]) == p) if parts[goal] > 1 else np.arange(len(h))
                            hit = pick[held[goal, p].may_hold(h[pick])]
                            if len(hit):
                                near = [group[i][:j] + (chr(x) if x >= 0 else "") + group[i][j + 1 :] for i, j, x in zip(w[hit].tolist(), at[hit].tolist(), c[hit].tolist(), strict=True)]
                                own = [group[i] for i in w[hit].tolist()]
                                yield pa.RecordBatch.from_pydict({"word": pa.array(own, pa.string()), "n": pa.array([ns[x] for x in own], pa.int64()), "other": pa.array(near, pa.string())})

        hits = words.select("word", "n").mapInArrow(probe, "word string, n long, other string")
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return spark.createDataFrame([], "word string, n long, other string, other_n long")
    exact = found.join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    both = F.array(F.struct("word", "n", "other", "other_n"), F.struct(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    return exact.select(F.inline(both))


def forms(words: DataFrame, ratio: int = 2) -> DataFrame:
    """words: (word, n). Returns word, n, n_near, form, form_n, root.

    form: the near word of largest n, the smallest in code-point order on ties, if its n is at least ratio times the word's.
    root: where the forms lead to; the word itself without one. As n grows from form to form, forms have no cycles.
    """
    near = near_words(words)
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("least"), F.col("other").alias("form"))).alias("best"))
    joined = words.join(best, "word", "left")
    big = -F.col("best.least") >= ratio * F.col("n")
    own = joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(big, F.col("best.form")).alias("form"), F.when(big, -F.col("best.least")).alias("form_n"))
    own = checkpointed(own)
    links = own.filter("form is not null").select("word", F.col("form").alias("root"))
    while True:  # each round doubles the steps behind a link
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = checkpointed(links.join(further, "root", "left").select("word", "root", "next"))
        if joined.filter("next is not null").isEmpty():
            break
        links = joined.select("word", F.coalesce("next", "root").alias("root"))
    return own.join(joined.select("word", "root"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_forms(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The vocabulary of docs with its variants; further columns of docs are ignored, an empty table gives no rows."""
    return forms(checkpointed(vocabulary(docs, id_col, text_col)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_forms(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("word", "form", "root", "n", "n_near", "form_n")


SQL = f"""
WITH RECURSIVE crcs AS ({CRC_TABLE}),
runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents WHERE text IS NOT NULL
), own AS (
  SELECT doc_id, run, count(*) AS n FROM runs GROUP BY doc_id, run
), hashed AS (
  SELECT run, n, {crc_sql("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run")} AS h FROM own, crcs
), words AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n
  FROM (SELECT CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), places AS MATERIALIZED (
  SELECT word, n, i, left(word, i) || substring(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM words)
), pairs AS (
  SELECT a.word AS word, b.word AS other, b.n AS other_n FROM places a JOIN places b ON a.i = b.i AND a.rest = b.rest AND length(a.word) = length(b.word) AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM places a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM places a JOIN words b ON a.rest = b.word
), best AS (
  SELECT word, count(*) AS n_near, max(other_n) AS form_n, min((-other_n, encode(other))) AS top FROM pairs GROUP BY word
), own_forms AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.form_n >= 2 * w.n THEN decode(b.top[2]) END AS form, CASE WHEN b.form_n >= 2 * w.n THEN b.form_n END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word
), chain AS (
  SELECT word, word AS root, form AS next FROM own_forms
  UNION ALL SELECT c.word, o.word, o.form FROM chain c JOIN own_forms o ON c.next = o.word
)
SELECT o.word, o.form, c.root, o.n, o.n_near, o.form_n FROM own_forms o JOIN chain c ON o.word = c.word AND c.next IS NULL
"""
