"""Route every window of every text to a shard that depends on the window's content alone.

A window (400 bytes, 13 words) holds a few k-grams; the one with the least hash is its anchor.
Neighbouring windows mostly share an anchor and travel as one fragment. Equal windows have equal
anchors, so all occurrences of a window meet in one shard, whatever texts they stand in. Anchors that
occur once in the whole input can't belong to a repeated window; ``repeated_runs`` finds the
others from 16 bytes an anchor, and only their fragments are shipped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buildtrail.llm import textnp as tn
from buildtrail.llm.keys import ident
from buildtrail.llm.session import checkpointed
from buildtrail.ship import ship

NONE = np.uint32(0xFFFFFFFF)
RUNS = 1 << 21  # in a shard, 16 bytes each


class Runs:
    """Fragments of some texts: text, first window (from the text's start), windows, anchor (same), key."""

    def __init__(self, doc, first, count, anchor, key):
        self.doc, self.first, self.count, self.anchor, self.key = doc, first, count, anchor, key

    def ordinals(self) -> np.ndarray:
        """The place of each fragment within its text."""
        if not len(self.doc):
            return np.zeros(0, np.int64)
        new = np.concatenate([[True], np.diff(self.doc) != 0])
        at = np.arange(len(self.doc))
        return at - np.maximum.accumulate(np.where(new, at, 0))


def unit_runs(hashes: np.ndarray, offs: np.ndarray, window: int, k: int) -> Runs:
    """hashes: of the k-grams that start at each unit; offs: the texts' offsets in units."""
    n = int(offs[-1])
    doc_of = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    w = window - k + 1
    anchor = tn.minimisers(hashes, w)
    ok = np.zeros(len(anchor), bool)
    m = min(len(anchor), n - window + 1)
    if m > 0:
        ok[:m] = doc_of[:m] == doc_of[window - 1 : window - 1 + m]
    first, count, at = tn.runs_of(ok, anchor)
    doc = doc_of[first]
    return Runs(doc, first - offs[doc], count, at - offs[doc], tn.mix(hashes[at] + np.uint64(1)))


def byte_runs(buf: np.ndarray, offs: np.ndarray, window: int, k: int) -> Runs:
    """Runs of byte windows; long texts are cut to overlapping parts so that memory stays bounded."""
    parts = []
    if len(offs) == 2 and len(buf) > tn.CHUNK + window:
        step = tn.CHUNK - window
        for s in range(0, len(buf) - window + 1, step):
            part = buf[s : s + step + window - 1]
            r = byte_runs(part, np.array([0, len(part)]), window, k)
            parts.append(Runs(r.doc, r.first + s, r.count, r.anchor + s, r.key))
        return Runs(*(np.concatenate([getattr(p, a) for p in parts]) for a in ("doc", "first", "count", "anchor", "key")))
    n = len(buf) - k + 1
    if n <= 0:
        return unit_runs(np.zeros(0, np.uint64), np.zeros(len(offs), np.int64), window, k)
    return unit_runs(tn.rolling_hash(buf, k), offs, window, k)


def word_runs(hashes: np.ndarray, offs: np.ndarray, window: int, k: int) -> Runs:
    return unit_runs(tn.grams(hashes, k), offs, window, k)


def pack(shard: np.ndarray, columns: list[np.ndarray], shards: int) -> Iterator[tuple[int, bytes]]:
    """Rows of equal shard as one blob: their number, then column after column."""
    if not len(shard):
        return
    order = np.argsort(shard, kind="stable")
    ids, starts = np.unique(shard[order], return_index=True)
    columns = [c[order] for c in columns]
    for i, s, e in zip(ids, starts, [*starts[1:], len(order)], strict=True):
        yield int(i), b"".join([np.int64(e - s).tobytes(), *(c[s:e].tobytes() for c in columns)])


def unpack(blobs: Iterator[bytes], kinds: list[type]) -> list[np.ndarray]:
    parts: list[list[np.ndarray]] = [[np.zeros(0, k)] for k in kinds]
    for blob in blobs:
        n, at = int(np.frombuffer(blob, np.int64, 1)[0]), 8
        for p, k in zip(parts, kinds, strict=True):
            p.append(np.frombuffer(blob, k, n, at))
            at += n * np.dtype(k).itemsize
    return [np.concatenate(p) for p in parts]


KINDS = [np.uint32, np.int64, np.uint32]


def shards_for(count: int, each: int) -> int:
    """Shards of about ``each`` rows, so that a shard's size doesn't grow with the input."""
    return max(32, -(-count // each))


def repeated_runs(texts: DataFrame, runs: Callable[[np.ndarray, np.ndarray], Runs], unit: int) -> DataFrame:
    """texts: (k long, text). Returns (k, ord int): the runs whose anchor occurs more than once; unit: bytes of text that make about one run.

    A few runs that don't repeat may be among them (keys are cut to 32 bits beside the shard); no
    repeated one is missing. A task sends an anchor that it has met several times only once, so
    an anchor of a third of all texts costs a shard one row for each task, not for each text.
    """
    spark = texts.sparkSession
    ship(spark)
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = shards_for(size // unit, RUNS)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ks = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            buf, offs = tn.flat(batch.column(1))
            key, k, ordinal = [], [], []
            for i, j in tn.chunks(offs):
                r = runs(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                key.append(r.key)
                k.append(ks[i:j][r.doc])
                ordinal.append(r.ordinals().astype(np.uint32))
            if not key:
                continue
            key, k, ordinal = np.concatenate(key), np.concatenate(k), np.concatenate(ordinal)
            order = np.argsort(key, kind="stable")
            key, k, ordinal = key[order], k[order], ordinal[order]
            new = np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]
            group = np.cumsum(new) - 1
            many = np.bincount(group)[group] > 1 if len(group) else new
            shard = (key % np.uint64(shards)).astype(np.int64)
            short = (key >> np.uint64(32)).astype(np.uint32)
            rows = list(pack(-1 - shard[many], [short[many], k[many], ordinal[many]], shards))
            rows += pack(shard[new], [short[new], k[new], np.where(many, NONE, ordinal)[new]], shards)
            yield pa.RecordBatch.from_pydict({"shard": pa.array([x[0] for x in rows], pa.int32()), "rows": pa.array([x[1] for x in rows], pa.binary())})

    def meet(table: pa.Table) -> pa.Table:
        short, k, ordinal = unpack((x.as_py() for x in table.column("rows")), KINDS)
        if table.column("shard")[0].as_py() >= 0:
            order = np.argsort(short, kind="stable")
            short, k, ordinal = short[order], k[order], ordinal[order]
            same = short[1:] == short[:-1]
            hit = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            hit &= ordinal != NONE
            k, ordinal = k[hit], ordinal[hit]
        return pa.table({"k": k, "ord": ordinal.astype(np.int32)})

    sent = texts.select("k", "text").mapInArrow(send, "shard int, rows binary")
    return sent.groupBy("shard").applyInArrow(meet, "k long, ord int")


def candidates(whole: DataFrame, texts: DataFrame, later: DataFrame, runs: Callable[[np.ndarray, np.ndarray], Runs], unit: int) -> tuple[DataFrame, int]:
    """(k, rank, text, ords) of the texts with a repeated run, without those that ``later`` (k, rank) names; and how many such runs there are.

    whole: ``texts`` dealt by k; every join here is by k alone, so that the texts are dealt once.
    """
    found = checkpointed(repeated_runs(texts, runs, unit))
    some = found.select("k", "ord", F.lit(None).cast("long").alias("later"))
    skip = later.select("k", F.lit(None).cast("int").alias("ord"), F.col("rank").alias("later"))
    flags = some.unionByName(skip).groupBy("k").agg(F.collect_list("ord").alias("ords"), F.collect_set("later").alias("later")).filter("size(ords) > 0")
    return whole.join(flags, "k").filter("not array_contains(later, rank)").select("k", "rank", "text", "ords"), found.count()


def with_spans(whole: DataFrame, spans: DataFrame) -> DataFrame:
    """(id, text, starts, lens): each text with its rows of spans (k, rank, start, len)."""
    by = spans.groupBy("k").agg(F.collect_list(F.struct("rank", "start", "len")).alias("spans"))
    own = F.filter("spans", lambda x: x["rank"] == F.col("rank"))
    return whole.join(by, "k", "left").withColumn("own", own).select(ident().alias("id"), "text", F.col("own.start").alias("starts"), F.col("own.len").alias("lens"))
