"""Suffix-array dedup with a logarithmic index family.

A byte goes when a ``window``-byte string over it also starts anywhere else, in another text or the
same. Windows are routed to shards by content (see ``anchored``); all occurrences of one meet in
one shard, aligned at their anchor.

Each shard keeps a family of suffix arrays. Fragments come in batches. A batch gets a suffix array:
its anchored suffixes in the order of (anchor, bytes from the anchor on), and likewise the bytes
before the anchor read backwards, each with the longest common prefixes of neighbours. The batch is
scanned against every existing level; fragments of equal anchor are merged in suffix order, and two of
them share the windows that their common bytes before and after the anchor leave room for. Then the
batch becomes a level, and levels of equal size merge to one of twice the size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buildtrail.llm import textnp as tn
from buildtrail.llm.anchored import byte_runs, candidates, pack, shards_for, unpack, with_spans
from buildtrail.llm.keys import copies, keyed
from buildtrail.ship import ship, shuffle_partitions

BATCH, BATCHES, FEW = 2048, 8, 5
SHARD = 1 << 13  # fragments, about 3 KB each while they are compared


class Fragments:
    """Distinct fragments of a shard as fixed-width rows: anchor key, bytes after and (reversed) before it."""

    def __init__(self, key: np.ndarray, after: np.ndarray, n_after: np.ndarray, before: np.ndarray, n_before: np.ndarray):
        self.key, self.after, self.n_after, self.before, self.n_before = key, after, n_after, before, n_before
        n = len(key)
        head = key.astype(">u8").view(np.uint8).reshape(n, 8)
        tail = lambda x: x.astype(">u2").view(np.uint8).reshape(n, 2)
        fixed = lambda *parts: np.ascontiguousarray(np.concatenate(parts, 1)).view(f"S{sum(p.shape[1] for p in parts)}").ravel()
        self.forward, self.backward = fixed(head, after, tail(n_after)), fixed(head, before, tail(n_before))


def common(rows: np.ndarray, size: np.ndarray, key: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bytes that rows a and b have in common from the left; 0 for different anchors."""
    out = np.empty(len(a), np.int64)
    for s in range(0, len(a), 1 << 14):
        x, y = a[s : s + (1 << 14)], b[s : s + (1 << 14)]
        differ = rows[x] != rows[y]
        first = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
        out[s : s + (1 << 14)] = np.minimum(first, np.minimum(size[x], size[y]))
    return np.where(key[a] == key[b], out, 0)


class Family:
    """Levels of suffix arrays over one shard's fragments; ``shared[i, s]``: the window of fragment i that starts s bytes before its anchor occurs elsewhere."""

    def __init__(self, fragments: Fragments, window: int):
        self.f, self.window = fragments, window
        self.shared = np.zeros((len(fragments.key), fragments.before.shape[1] + 2), np.int32)
        self.levels: list[np.ndarray] = []

    def add(self, rows: np.ndarray) -> None:
        """Take a batch in: sort it, scan it against itself and all levels, merge levels of equal size."""
        batch = rows[np.argsort(self.f.forward[rows], kind="stable")]
        self._scan(batch, batch[:0])
        for level in self.levels:
            self._scan(batch, level)
        self.levels.append(batch)
        while len(self.levels) > 1 and len(self.levels[-2]) <= len(self.levels[-1]):
            self.levels.append(self._merged(self.levels.pop(-2), self.levels.pop()))

    def _merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Two arrays in suffix order as one, without sorting anew."""
        out = np.empty(len(a) + len(b), np.int64)
        of_b = np.searchsorted(self.f.forward[a], self.f.forward[b], "right") + np.arange(len(b))
        of_a = np.ones(len(out), bool)
        of_a[of_b] = False
        out[of_b], out[of_a] = b, a
        return out

    def _scan(self, batch: np.ndarray, level: np.ndarray) -> None:
        """Both in suffix order. Mark what fragments of equal anchor share."""
        key = self.f.key
        if len(level):
            both = np.intersect1d(key[batch], key[level])
            at = lambda rows: rows[np.isin(key[rows], both)]
            rows = self._merged(at(batch), at(level))
        else:
            rows = batch
        if not len(rows):
            return
        cut = np.flatnonzero(np.concatenate([[True], key[rows][1:] != key[rows][:-1]]))
        size = np.diff(np.concatenate([cut, [len(rows)]]))
        for n in range(2, FEW + 1):
            base = cut[size == n]
            for i in range(n):
                for j in range(i + 1, n):
                    self._pairs(rows[base + i], rows[base + j])
        big = np.repeat(size > FEW, size)
        if big.any():
            self._classes(rows[big])

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> None:
        f = self.f
        after = common(f.after, f.n_after, f.key, a, b)
        before = common(f.before, f.n_before, f.key, a, b)
        low = self.window - after
        ok = low <= before
        for rows in (a[ok], b[ok]):
            np.add.at(self.shared, (rows, np.maximum(low[ok], 0)), 1)
            np.add.at(self.shared, (rows, before[ok] + 1), -1)

    def _classes(self, rows: np.ndarray) -> None:
        """rows in suffix order. At each offset, fragments are equal that fall in one class of common bytes on both sides."""
        f, n = self.f, len(rows)
        down = np.argsort(f.backward[rows], kind="stable")
        at = np.arange(n - 1)
        lcp_after = np.concatenate([[0], common(f.after, f.n_after, f.key, rows[at], rows[at + 1])])
        back = rows[down]
        lcp_before = np.concatenate([[0], common(f.before, f.n_before, f.key, back[at], back[at + 1])])
        apart = np.concatenate([[True], f.key[back][1:] != f.key[back][:-1]])
        class_before = np.empty(n, np.int64)
        for s in range(f.before.shape[1] + 1):
            fit = np.flatnonzero((f.n_before[rows] >= s) & (f.n_after[rows] >= self.window - s))
            if len(fit) < 2:
                continue
            class_before[down] = np.cumsum((lcp_before < s) | apart)
            code = class_before[fit] * (n + 1) + np.cumsum(lcp_after < self.window - s)[fit]
            order = np.argsort(code)
            same = code[order][1:] == code[order][:-1]
            hit = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            hit = rows[fit[order[hit]]]
            self.shared[hit, s] += 1
            self.shared[hit, s + 1] -= 1

    def repeated(self) -> np.ndarray:
        return np.cumsum(self.shared[:, :-1], 1) > 0


KINDS = [np.uint64, np.int64, np.int64, np.int32, np.int32, np.int32]  # anchor key, k, rank, first byte, bytes, bytes before the anchor


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 400, gram: int = 64) -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept binary): the UTF-8 bytes that stay, in a row.

    Null or empty text: 0 bytes, no spans. Ids aren't compared, so they may be null or repeat; a repeated
    row counts as another text. Each input row gives a row. Other columns are ignored.
    """
    return _removed(docs, id_col, text_col, window, gram, digest=False)


def _removed(docs: DataFrame, id_col: str, text_col: str, window: int, gram: int, digest: bool) -> DataFrame:
    spark = docs.sparkSession
    ship(spark)
    gram = min(gram, window)
    reach = window - gram
    texts = keyed(docs, id_col, text_col)
    whole = texts.repartition(shuffle_partitions(spark), "k")
    copied = copies(texts)
    some, n_runs = candidates(whole, texts, copied.filter("rank > first"), lambda buf, offs: byte_runs(buf, offs, window, gram), reach // 2 + 1)
    shards = shards_for(n_runs, SHARD)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, rank = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            buf, offs = tn.flat(batch.column(2))
            ords = batch.column(3)
            ords_flat, ords_offs = ords.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(ords.value_lengths().to_numpy(zero_copy_only=False))])
            for i, j in tn.chunks(offs):
                part, o = buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                r = byte_runs(part, o, window, gram)
                mine = ords_flat[ords_offs[i] : ords_offs[j]] + np.repeat(np.arange(j - i), np.diff(ords_offs[i : j + 1])) * (1 << 32)
                take = np.flatnonzero(np.isin(r.ordinals() + r.doc * (1 << 32), mine))
                if not len(take):
                    continue
                shard = (r.key[take] % np.uint64(shards)).astype(np.int64)
                order = np.argsort(shard, kind="stable")
                take, shard = take[order], shard[order]
                doc, first, n = r.doc[take], r.first[take], r.count[take] + window - 1
                body, cut = part[np.repeat(o[doc] + first, n) + tn.spread(n)], np.concatenate([[0], np.cumsum(n)])
                heads = list(pack(shard, [r.key[take], k[i:j][doc], rank[i:j][doc], first.astype(np.int32), n.astype(np.int32), (r.anchor[take] - first).astype(np.int32)], shards))
                begin = np.searchsorted(shard, [x[0] for x in heads])
                stop = np.searchsorted(shard, [x[0] for x in heads], "right")
                yield pa.RecordBatch.from_pydict({"shard": pa.array([x[0] for x in heads], pa.int32()), "heads": pa.array([x[1] for x in heads], pa.binary()), "body": pa.array([body[cut[b] : cut[e]].tobytes() for b, e in zip(begin, stop, strict=True)], pa.binary())})

    def match(table: pa.Table) -> pa.Table:
        key, k, rank, first, n, before = unpack((x.as_py() for x in table.column("heads")), KINDS)
        body = np.concatenate([np.frombuffer(x.as_py(), np.uint8) for x in table.column("body")])
        n, before = n.astype(np.int64), before.astype(np.int64)
        begin = np.cumsum(n) - n
        ident = np.empty(len(n), np.uint64)
        for s in range(0, len(n), 1024):
            e = min(len(n), s + 1024)
            part = body[begin[s] : begin[e - 1] + n[e - 1]]
            ident[s:e] = tn.span_hash(tn.prefix_sums(part), begin[s:e] - begin[s], begin[s:e] - begin[s] + n[s:e])
        ident = tn.mix(ident + key * np.uint64(3) + before.astype(np.uint64))
        _, pick, of, times = np.unique(ident, return_index=True, return_inverse=True, return_counts=True)

        def rows(start: np.ndarray, size: np.ndarray, width: int, step: int) -> np.ndarray:
            out = np.zeros((len(start), width), np.uint8)
            place = tn.spread(size)
            out[np.repeat(np.arange(len(start)), size), place] = body[np.repeat(start, size) + step * place]
            return out

        at, size = begin[pick], before[pick]
        n_after = n[pick] - size
        family = Family(Fragments(key[pick], rows(at + size, n_after, window, 1), n_after, rows(at + size - 1, size, reach, -1), size), window)
        step = max(BATCH, -(-len(pick) // BATCHES))
        for s in range(0, len(pick), step):
            family.add(np.arange(s, min(len(pick), s + step)))
        offset = np.arange(reach + 1)
        there = (offset <= size[:, None]) & (offset >= window - n_after[:, None])
        hit = there & (family.repeated() | (times > 1)[:, None])
        edge = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        of_run, low = np.nonzero(edge == 1)
        _, high = np.nonzero(edge == -1)
        runs = np.bincount(of_run, minlength=len(pick))
        run_at = np.cumsum(runs) - runs
        many = runs[of]
        occ = np.repeat(np.arange(len(of)), many)
        run = np.repeat(run_at[of], many) + tn.spread(many)
        return pa.table({"k": k[occ], "rank": rank[occ], "start": (first[occ] + before[occ] - high[run] + 1).astype(np.int32), "len": (high[run] - low[run] + window - 1).astype(np.int32)})

    spans = some.mapInArrow(send, "shard int, heads binary, body binary").groupBy("shard").applyInArrow(match, "k long, rank long, start int, len int")
    joined = with_spans(whole, spans.unionByName(copied.select("k", "rank", F.lit(0).alias("start"), F.lit(-1).alias("len"))))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = tn.flat(batch.column(1))
            starts, lens = batch.column(2), batch.column(3)
            n_spans = starts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            s_flat, l_flat = (c.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in (starts, lens))
            s_offs = np.concatenate([[0], np.cumsum(n_spans)])
            for i, j in tn.chunks(offs):
                o = offs[i : j + 1] - offs[i]
                part, size = buf[offs[i] : offs[j]], np.diff(o)
                s, n = s_flat[s_offs[i] : s_offs[j]], l_flat[s_offs[i] : s_offs[j]]
                doc = np.repeat(np.arange(j - i), n_spans[i:j])
                n = np.where(n < 0, np.where(size[doc] >= window, size[doc], 0), n)
                mark = np.zeros(len(part) + 1, np.int32)
                np.add.at(mark, o[doc] + s, 1)
                np.add.at(mark, o[doc] + s + n, -1)
                gone = np.cumsum(mark[:-1]) > 0
                new = gone & ~np.concatenate([[False], gone[:-1]])
                new[o[:-1][size > 0]] = gone[o[:-1][size > 0]]
                total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[o])  # noqa: B023, E731
                removed = total(gone)
                cut = np.concatenate([[0], np.cumsum(size - removed)])
                raw = part[~gone].tobytes()
                kept = [raw[x:y] for x, y in zip(cut[:-1], cut[1:], strict=True)]
                if digest:
                    kept = [hashlib.sha256(x).hexdigest() for x in kept]
                yield pa.RecordBatch.from_pydict({id_col: batch.column(0).slice(i, j - i).cast(pa.int64()), "n_bytes": pa.array(size, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(total(new), pa.int64()), "kept_sha256" if digest else "kept": pa.array(kept, pa.string() if digest else pa.binary())})

    return joined.mapInArrow(keep, f"{id_col} long, n_bytes long, n_removed long, n_spans long, " + ("kept_sha256 string" if digest else "kept binary"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _removed(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", 400, 64, digest=True)
