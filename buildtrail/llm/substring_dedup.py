"""Substring dedup: a compressed FM-index per shard and streamed matching statistics.

Words are whatever stands between ASCII white space. A window is ``window`` consecutive words of
one document; a word goes when a window over it also starts in a document with a smaller id.

Windows are routed to shards by content (see ``anchored``), so all occurrences of one meet in one
shard. There the distinct fragments form a text over a local word alphabet. Its Burrows-Wheeler
transform is kept as a wavelet matrix of packed bits with block counts; fragments stream
through backward search, all of a shard in step. An interval that has reached the threshold is
reported with the smallest document of its suffixes, then widened to the context one word shorter (by
stored marks of equal prefixes), so each word costs one backward step, not one for each window over it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buildtrail.llm import textnp as tn
from buildtrail.llm.anchored import candidates, pack, shards_for, unpack, with_spans, word_runs
from buildtrail.llm.keys import copies, keyed
from buildtrail.ship import ship, shuffle_partitions

GRAM = 4
SHARD = 1 << 15  # fragments of about 18 words


class FMIndex:
    """FM-index of several word sequences for windows of ``window`` words. Symbol 0 parts the sequences; words are 1 to sigma.

    Of the text and its suffix array only this stays: the transform as a wavelet matrix of packed bits with block
    counts, each suffix's sequence, and for each suffix where the suffixes with its first window - 1 words begin and end.
    """

    def __init__(self, codes: np.ndarray, lengths: np.ndarray, window: int):
        """codes: the words of all sequences (1..sigma) in a row; lengths: of each sequence."""
        n = len(codes) + len(lengths)
        text = np.zeros(n, np.int64)
        text[np.arange(len(codes)) + np.repeat(np.arange(len(lengths)), lengths)] = codes
        self.size, self.sigma = n, int(codes.max(initial=0))
        parts = np.flatnonzero(text == 0)
        ordered = text + len(parts)
        ordered[parts] = np.arange(len(parts))  # parting symbols differ, so no two suffixes are equal
        rank, h = ordered, 1
        while True:
            follow = np.zeros(n, np.int64)
            follow[: max(0, n - h)] = rank[h:] + 1
            key = rank * (n + self.sigma + 2) + follow
            sa = np.argsort(key, kind="stable")
            key = key[sa]
            new = np.empty(n, np.int64)
            new[sa] = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
            rank = new
            if rank[sa[-1]] == n - 1:
                break
            h *= 2
        self.sequence = np.repeat(np.arange(len(lengths)), lengths + 1)[sa].astype(np.int32)
        apart = np.zeros(n, bool)  # from the suffix before, within the words seen so far
        apart[0] = True
        at = np.arange(n, dtype=np.int32)
        for j in range(window):
            if j == window - 1:
                last = np.concatenate([apart[1:], [True]])
                self.low = np.maximum.accumulate(np.where(apart, at, 0)).astype(np.int32)
                self.high = np.minimum.accumulate(np.where(last, at + 1, n)[::-1])[::-1].astype(np.int32)
            symbol = ordered[np.minimum(sa + j, n - 1)]
            apart[1:] |= symbol[1:] != symbol[:-1]
        self.firsts = np.flatnonzero(apart).astype(np.int32)  # of the suffixes that start with one window
        row = text[sa - 1]
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.sigma + 1))])
        self.levels = max(1, self.sigma.bit_length())
        self.bits, self.blocks, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (row >> level) & 1
            padded = np.zeros((n // 64 + 1) * 64, np.uint8)
            padded[:n] = bit
            packed = np.packbits(padded, bitorder="little").view(np.uint64)
            self.bits.append(packed)
            self.blocks.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int32)]).astype(np.int32))
            self.zeros.append(n - int(bit.sum()))
            row = np.concatenate([row[bit == 0], row[bit == 1]])
        symbols = np.arange(self.sigma + 1)
        self.base = self._map(np.zeros(self.sigma + 1, np.int64), symbols)

    def _map(self, at: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Follow positions down the wavelet matrix along their symbols' bits."""
        for depth, (bits, blocks, zeros) in enumerate(zip(self.bits, self.blocks, self.zeros, strict=True)):
            block = at >> 6
            ones = blocks[block] + np.bitwise_count(bits[block] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))).astype(np.int64)
            one = (symbol >> (self.levels - 1 - depth)) & 1
            at = np.where(one == 1, zeros + ones, at - ones)
        return at

    def extend(self, low: np.ndarray, high: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One backward step: intervals of the suffixes that start with symbol and then the old context."""
        both = self._map(np.concatenate([low, high]), np.concatenate([symbol, symbol])) - np.concatenate([self.base[symbol]] * 2)
        both += np.concatenate([self.before[symbol]] * 2)
        return both[: len(low)], both[len(low) :]

    def least(self, owner: np.ndarray) -> np.ndarray:
        """The least owner of the suffixes that start with one window, for each such group."""
        return np.minimum.reduceat(owner[self.sequence], self.firsts)


def shorter(index: FMIndex, codes: np.ndarray, at: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The longest matches, of at most ``most`` words, that start at these places: intervals and lengths."""
    low, high, length = np.zeros(len(at), np.int64), np.full(len(at), index.size), np.zeros(len(at), np.int64)
    for d in range(int(most.max(initial=0)), 0, -1):
        rows = np.flatnonzero((length == 0) & (most >= d))
        a, b = np.zeros(len(rows), np.int64), np.full(len(rows), index.size)
        for i in range(d - 1, -1, -1):
            a, b = index.extend(a, b, codes[at[rows] + i])
        found = a < b
        low[rows[found]], high[rows[found]], length[rows[found]] = a[found], b[found], d
    return low, high, length


def search(index: FMIndex, owner: np.ndarray, codes: np.ndarray, lengths: np.ndarray, window: int) -> np.ndarray:
    """Stream word sequences (coded as the index is) backwards through it: the least owner among all occurrences of each of their windows, in order.

    A sequence's matching statistics end at the threshold: once ``window`` words match, the interval is reported and then
    widened to its first window - 1 words. Windows that don't occur get the largest number.
    """
    least, none = index.least(owner), np.iinfo(owner.dtype).max
    windows = np.maximum(lengths - window + 1, 0)
    first_window, begin = np.cumsum(windows) - windows, np.cumsum(lengths) - lengths
    out = np.full(int(windows.sum()), none, owner.dtype)
    live = np.arange(len(lengths))
    low, high = np.zeros(len(live), np.int64), np.full(len(live), index.size)
    matched = np.zeros(len(live), np.int64)  # words
    for t in range(int(lengths.max(initial=0))):
        stay = lengths[live] > t
        live, low, high, matched = live[stay], low[stay], high[stay], matched[stay]
        place = lengths[live] - 1 - t
        low, high = index.extend(low, high, codes[begin[live] + place])
        lost = np.flatnonzero(low >= high)
        matched += 1
        if len(lost):
            low[lost], high[lost], matched[lost] = shorter(index, codes, begin[live[lost]] + place[lost], matched[lost] - 1)
        full = matched == window
        if full.any():
            at = low[full]
            out[first_window[live[full]] + place[full]] = least[np.searchsorted(index.firsts, at, "right") - 1]
            low[full], high[full], matched[full] = index.low[at], index.high[at], window - 1
    return out


KINDS = [np.int64, np.int64, np.int32, np.int32]  # k, rank, first word, words


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13) -> DataFrame:
    """(id_col, n_words, n_removed, kept): kept has the words that stay, joined by one space.

    Null or empty text: 0 words, kept "". Null ids count as larger than any other; rows of the same id
    don't remove each other's words. Repeated rows give a row each. Other columns are ignored.
    """
    out = _removed(docs, id_col, text_col, window, digest=False)
    return out.withColumn("kept", F.decode("kept", "utf-8"))


def _removed(docs: DataFrame, id_col: str, text_col: str, window: int, digest: bool) -> DataFrame:
    spark = docs.sparkSession
    ship(spark)
    texts = keyed(docs, id_col, text_col)
    gram = min(GRAM, window)

    def runs(buf, offs):
        _, _, h, wo = tn.words(buf, offs)
        return word_runs(h, wo, window, gram)

    later = copies(texts).filter("rank > first")
    whole = texts.repartition(shuffle_partitions(spark), "k")
    some, n_runs = candidates(whole, texts, later, runs, 3 * (window - gram + 2))
    shards = shards_for(n_runs, SHARD)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, rank = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            buf, offs = tn.flat(batch.column(2))
            ords = batch.column(3)
            ords_flat, ords_offs = ords.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(ords.value_lengths().to_numpy(zero_copy_only=False))])
            for i, j in tn.chunks(offs):
                _, _, h, wo = tn.words(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                r = word_runs(h, wo, window, gram)
                mine = ords_flat[ords_offs[i] : ords_offs[j]] + np.repeat(np.arange(j - i), np.diff(ords_offs[i : j + 1])) * (1 << 32)
                take = np.isin(r.ordinals() + r.doc * (1 << 32), mine)
                if not take.any():
                    continue
                doc, first, n = r.doc[take], r.first[take], r.count[take] + window - 1
                shard = (r.key[take] % np.uint64(shards)).astype(np.int64)
                order = np.argsort(shard, kind="stable")
                doc, first, n, shard = doc[order], first[order], n[order], shard[order]
                at = np.repeat(wo[doc] + first, n) + tn.spread(n)
                body, cut = h[at], np.concatenate([[0], np.cumsum(n)])
                heads = list(pack(shard, [k[i:j][doc], rank[i:j][doc], first.astype(np.int32), n.astype(np.int32)], shards))
                begin = np.searchsorted(shard, [x[0] for x in heads])
                stop = np.searchsorted(shard, [x[0] for x in heads], "right")
                yield pa.RecordBatch.from_pydict({"shard": pa.array([x[0] for x in heads], pa.int32()), "heads": pa.array([x[1] for x in heads], pa.binary()), "body": pa.array([body[cut[b] : cut[e]].tobytes() for b, e in zip(begin, stop, strict=True)], pa.binary())})

    def match(table: pa.Table) -> pa.Table:
        k, rank, first, n = unpack((x.as_py() for x in table.column("heads")), KINDS)
        body = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in table.column("body")])
        n = n.astype(np.int64)
        begin = np.cumsum(n) - n
        place = tn.spread(n)
        steps = tn.mix(np.arange(1, int(n.max(initial=1)) + 1, dtype=np.uint64)) | np.uint64(1)
        ident = tn.mix(np.add.reduceat(body * steps[place], begin) + n.astype(np.uint64))
        _, pick, of = np.unique(ident, return_index=True, return_inverse=True)
        owner = np.full(len(pick), np.iinfo(np.int64).max)
        np.minimum.at(owner, of, rank)
        lengths = n[pick]
        text = body[np.repeat(begin[pick], lengths) + tn.spread(lengths)]
        _, codes = np.unique(text, return_inverse=True)
        least = search(FMIndex(codes + 1, lengths, window), owner, codes + 1, lengths, window)
        windows = lengths - window + 1
        w_begin = np.cumsum(windows) - windows
        many = windows[of]
        occ = np.repeat(np.arange(len(of)), many)
        j = tn.spread(many)
        gone = least[np.repeat(w_begin[of], many) + j] < rank[occ]
        occ, j = occ[gone], j[gone]
        cut = np.flatnonzero((np.diff(occ) != 0) | (np.diff(j) != 1)) + 1 if len(occ) else np.zeros(0, np.int64)
        s = np.concatenate([[0], cut]).astype(np.int64) if len(occ) else cut
        count = np.diff(np.concatenate([s, [len(occ)]]))
        occ, j = occ[s], j[s]
        return pa.table({"k": k[occ], "rank": rank[occ], "start": (first[occ] + j).astype(np.int32), "len": (count + window - 1).astype(np.int32)})

    spans = some.mapInArrow(send, "shard int, heads binary, body binary").groupBy("shard").applyInArrow(match, "k long, rank long, start int, len int")
    copied = later.select("k", "rank", F.lit(0).alias("start"), F.lit(-1).alias("len"))
    joined = with_spans(whole, spans.unionByName(copied))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = tn.flat(batch.column(1))
            starts, lens = batch.column(2), batch.column(3)
            n_spans = starts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            s_flat, l_flat = (c.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in (starts, lens))
            s_offs = np.concatenate([[0], np.cumsum(n_spans)])
            for i, j in tn.chunks(offs):
                part = buf[offs[i] : offs[j]]
                b, e = tn.word_spans(part, offs[i : j + 1] - offs[i])
                wo = np.searchsorted(b, offs[i : j + 1] - offs[i])
                s, n = s_flat[s_offs[i] : s_offs[j]], l_flat[s_offs[i] : s_offs[j]]
                doc = np.repeat(np.arange(j - i), n_spans[i:j])
                size = np.diff(wo)
                n = np.where(n < 0, np.where(size[doc] >= window, size[doc], 0), n)
                mark = np.zeros(len(b) + 1, np.int64)
                np.add.at(mark, wo[doc] + s, 1)
                np.add.at(mark, wo[doc] + s + n, -1)
                stay = np.cumsum(mark[:-1]) == 0
                removed = size - np.diff(np.concatenate([[0], np.cumsum(stay)])[wo])
                b, e = b[stay], e[stay]
                of = np.repeat(np.arange(j - i), size)[stay]
                last = np.concatenate([of[1:] != of[:-1], [True]]) if len(of) else np.zeros(0, bool)
                n_out = e - b + ~last
                gap = np.zeros(int(n_out.sum()), np.uint8) + np.uint8(32)
                stop = np.cumsum(n_out)
                body = np.repeat(stop - n_out, e - b) + tn.spread(e - b)
                gap[body] = part[np.repeat(b, e - b) + tn.spread(e - b)]
                cut = np.concatenate([[0], stop])[np.concatenate([[0], np.cumsum(np.bincount(of, minlength=j - i))])]
                raw = gap.tobytes()
                kept = [raw[x:y] for x, y in zip(cut[:-1], cut[1:], strict=True)]
                if digest:
                    kept = [hashlib.sha256(x).hexdigest() for x in kept]
                yield pa.RecordBatch.from_pydict({id_col: batch.column(0).slice(i, j - i).cast(pa.int64()), "n_words": pa.array(size, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256" if digest else "kept": pa.array(kept, pa.string() if digest else pa.binary())})

    return joined.mapInArrow(keep, f"{id_col} long, n_words long, n_removed long, " + ("kept_sha256 string" if digest else "kept binary"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _removed(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", 13, digest=True)
