"""Packing of tokenised documents into fixed windows by non-negative least squares.

Documents are cut at whole windows; what is left of each is a piece. Pieces are counted by length in
units of window / 256. Combinations of at most three different lengths that fill the window are
enumerated, the repeat counts that match the histogram best are solved by non-negative least
squares, rounded down, and what remains is packed greedily, longest first. All that happens on 256 counts.
On Spark, pieces get a rank within their length from salted counts and take the slot of that rank.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from buildtrail.llm import textnp as tn
from buildtrail.llm.keys import ident, keyed
from buildtrail.llm.session import checkpointed
from buildtrail.ship import ship, shuffle_partitions

UNITS = 256
WORDS_KEPT = 1 << 21
_workers: dict[str, "Vocabulary"] = {}


class Vocabulary:
    """Token ids of words met so far, by word hash. The tokenizer drops white space, so ids don't depend on neighbours."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.specials = {x.content: i for i, x in self.tokenizer.get_added_tokens_decoder().items()}
        self._forget()

    def _forget(self) -> None:
        self.hash, self.start, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _encode(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word; one call for all, with a special token between words."""
        if not self.specials:
            return [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch(words, add_special_tokens=False)]
        part, mark = next(iter(self.specials.items()))
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(words)
        odd = [i for i, w in enumerate(words) if any(s in w for s in self.specials)]
        for i in odd:
            out[i] = np.array(self.tokenizer.encode(words[i], add_special_tokens=False).ids, np.uint32)
        plain = [i for i in range(len(words)) if i not in set(odd)] if odd else range(len(words))
        for s in range(0, len(plain), 2048):
            some = plain[s : s + 2048]
            ids = np.array(self.tokenizer.encode(f" {part} ".join(words[i] for i in some), add_special_tokens=False).ids, np.uint32)
            cut = np.flatnonzero(ids == mark)
            for i, x in zip(some, np.split(ids, cut), strict=True):
                out[i] = x[1:] if len(x) and x[0] == mark else x
        return out

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the texts' offsets into them."""
        starts, ends, h, wo = tn.words(buf, offs)
        unique, first, of = np.unique(h, return_index=True, return_inverse=True)
        at = np.searchsorted(self.hash, unique)
        at[at == len(self.hash)] = 0
        new = np.flatnonzero(self.hash[at] != unique) if len(self.hash) else np.arange(len(unique))
        if len(new):
            if len(self.hash) + len(new) > WORDS_KEPT:
                self._forget()
                new = np.arange(len(unique))
            raw = buf.tobytes()
            found = self._encode([raw[starts[i] : ends[i]].decode("utf-8", "replace") for i in first[new]])
            size = np.array([len(x) for x in found], np.int64)
            start = len(self.ids) + np.cumsum(size) - size
            self.ids = np.concatenate([self.ids, *found])
            place = np.searchsorted(self.hash, unique[new])
            self.hash, self.start, self.size = (np.insert(a, place, b) for a, b in ((self.hash, unique[new]), (self.start, start), (self.size, size)))
            at = np.searchsorted(self.hash, unique)
        size = self.size[at][of] if len(of) else np.zeros(0, np.int64)
        ids = self.ids[np.repeat(self.start[at][of], size) + tn.spread(size)] if len(of) else np.zeros(0, np.uint32)
        return ids, np.concatenate([[0], np.cumsum(size)])[wo]


def vocabulary(path: str) -> Vocabulary:
    """One for each Python worker, which may run many tasks."""
    if path not in _workers:
        _workers[path] = Vocabulary(path)
    return _workers[path]


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = 4096, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """(k, rank, id_col, start, length, ids_crc32, doc_tokens[, ids]): each document's ids and end_id, cut at whole windows."""
    ship(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = tn.flat(batch.column(3))
            words = vocabulary(tokenizer)
            for i, j in tn.chunks(offs, 4 * tn.CHUNK):
                ids, io = words.encode(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                total = np.diff(io) + 1
                n = -(-total // window)
                doc = np.repeat(np.arange(j - i), n)
                start = tn.spread(n) * window
                length = np.minimum(window, total[doc] - start)
                body = np.insert(ids, io[1:], end_id).astype("<u4").tobytes()
                at = (io[:-1] + np.arange(j - i))[doc] + start
                raw = [body[4 * a : 4 * (a + x)] for a, x in zip(at, length, strict=True)]
                out = {"k": batch.column(0).slice(i, j - i).take(pa.array(doc)), "rank": batch.column(1).slice(i, j - i).take(pa.array(doc)), id_col: batch.column(2).slice(i, j - i).take(pa.array(doc))}
                out |= {"start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array([zlib.crc32(x) for x in raw], pa.int64()), "doc_tokens": pa.array(total[doc], pa.int64())}
                if with_ids:
                    out["ids"] = pa.array(raw, pa.binary())
                yield pa.RecordBatch.from_pydict(out)

    texts = keyed(docs, id_col, text_col).select("k", "rank", ident().alias("id"), "text")
    return texts.mapInArrow(cut, f"k long, rank long, {id_col} long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids)


def shallow_combinations(lengths: list[int], units: int = UNITS) -> np.ndarray:
    """Counts of each length in every way to fill ``units`` with one or two lengths, repeated at will, or three different ones."""
    at = {q: i for i, q in enumerate(lengths)}
    found: set[tuple[tuple[int, int], ...]] = {((q, units // q),) for q in lengths if units % q == 0}
    for a, b in combinations(lengths, 2):
        for n in range(1, (units - b) // a + 1):
            if (units - a * n) % b == 0:
                found.add(((a, n), (b, (units - a * n) // b)))
    for a, b in combinations(lengths, 2):
        if units - a - b > b and units - a - b in at:
            found.add(((a, 1), (b, 1), (units - a - b, 1)))
    out = np.zeros((len(lengths), len(found)))
    for j, way in enumerate(sorted(found)):
        for q, n in way:
            out[at[q], j] = n
    return out


def non_negative_least_squares(a: np.ndarray, b: np.ndarray, most: int = 600) -> np.ndarray:
    """x >= 0 with least |ax - b|, by the active-set method on the normal equations; ends after ``most`` steps with the best so far."""
    x, used = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    target = a.T @ b
    least = 1e-7 * max(1.0, float(np.abs(target).max(initial=0)))
    for _ in range(most):
        slope = target - a.T @ (a[:, used] @ x[used])
        slope[used] = -np.inf
        best = int(np.argmax(slope)) if len(slope) else -1
        if best < 0 or slope[best] <= least:
            break
        used[best] = True
        while used.any():
            on = np.flatnonzero(used)
            part = a[:, on]
            gram = part.T @ part
            fit = np.linalg.solve(gram + np.eye(len(on)) * (1e-10 * np.trace(gram)), target[on])
            if (fit > 0).all():
                x[:] = 0
                x[on] = fit
                break
            low = fit <= 0
            share = float(np.min(x[on][low] / np.maximum(x[on][low] - fit[low], 1e-12)))
            x[on] += share * (fit - x[on])
            used &= x > 1e-9
            x[~used] = 0
    return x


def plan(histogram: dict[int, int], units: int = UNITS) -> list[tuple[int, list[tuple[int, int]]]]:
    """[(repeats, [(length, count)])] that hold every piece of the histogram (length in units: pieces) once."""
    left = {q: n for q, n in histogram.items() if n > 0}
    out: list[tuple[int, list[tuple[int, int]]]] = []

    def take(repeats: int, way: list[tuple[int, int]]) -> None:
        out.append((repeats, way))
        for q, n in way:
            left[q] -= repeats * n
            if not left[q]:
                del left[q]

    if left:
        lengths = sorted(left)
        ways = shallow_combinations(lengths, units)
        scale = np.array([left[q] for q in lengths], float)
        weight = np.sqrt(np.array(lengths, float))  # longer pieces are harder to place later
        x = non_negative_least_squares(ways * weight[:, None], scale * weight) if ways.shape[1] else np.zeros(0)
        for j in np.argsort(-x, kind="stable"):
            way = [(lengths[i], int(ways[i, j])) for i in np.flatnonzero(ways[:, j])]
            repeats = min(int(x[j] + 1e-6), *(left.get(q, 0) // n for q, n in way))
            if repeats > 0:
                take(repeats, way)
    while left:
        room, way, repeats = units, [], None
        for q in sorted(left, reverse=True):
            n = min(room // q, left[q])
            if n:
                way.append((q, n))
                room -= q * n
        repeats = min(left[q] // n for q, n in way)
        take(repeats, way)
    return out


def pack(cut: DataFrame, window: int = 4096) -> DataFrame:
    """Adds sequence_id and offset to ``pieces``. Pieces of a sequence lie without gaps from 0 and sum to window at most.

    Empty input: no rows. Every input row, also a repeated one, is a piece of its own.
    """
    spark = cut.sparkSession
    unit = window // UNITS
    salts = max(8, shuffle_partitions(spark))
    sized = cut.withColumn("q", F.ceil(F.col("length") / unit).cast("int")).withColumn("salt", F.pmod(F.xxhash64("k", "rank", "start"), F.lit(salts)).cast("int"))
    counts = sized.groupBy("q", "salt").agg(F.count("*").alias("n"))
    histogram = {r["q"]: r["n"] for r in counts.groupBy("q").agg(F.sum("n").alias("n")).collect()}  # at most 256 rows
    slots, base = [], 0
    used: dict[int, int] = {}
    for repeats, way in plan(histogram):
        place = 0
        for q, n in way:
            first = used.get(q, 0)
            slots.append((q, first, first + repeats * n, base, n, place))
            used[q] = first + repeats * n
            place += n
        base += repeats
    slots_df = spark.createDataFrame(slots, "slot_q int, slot_from long, slot_to long, slot_base long, slot_n long, slot_place long")
    before = Window.partitionBy("q").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.withColumn("shift", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = Window.partitionBy("q", "salt").orderBy("rank", "k", "start")
    ranked = sized.withColumn("nth", F.row_number().over(within) - 1).join(F.broadcast(shifts), ["q", "salt"])  # at most 256 x salts rows
    nth = F.col("nth") + F.col("shift")
    placed = ranked.withColumn("nth", nth).join(F.broadcast(slots_df), (F.col("q") == F.col("slot_q")) & (F.col("nth") >= F.col("slot_from")) & (F.col("nth") < F.col("slot_to")))
    since = F.col("nth") - F.col("slot_from")
    placed = placed.withColumn("sequence_id", F.col("slot_base") + F.floor(since / F.col("slot_n"))).withColumn("place", F.col("slot_place") + since % F.col("slot_n"))
    earlier = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(earlier), F.lit(0)))
    return placed.select(*[c for c in cut.columns if c not in ("k", "rank")], "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = 4096, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """Tokenise, cut and pack. One row a piece: id_col, start, length, ids_crc32, doc_tokens[, ids], sequence_id, offset.

    A null or empty text is the end id alone. Null and repeated ids are kept as they are; repeated rows are
    packed each. tokenizer: a file for the tokenizers library whose tokenizer drops white space.
    """
    cut = pieces(docs, tokenizer, id_col, text_col, window, end_id, with_ids)
    return pack(checkpointed(cut), window)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer())
