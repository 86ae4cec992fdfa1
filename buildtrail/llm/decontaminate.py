"""Benchmark decontamination by latent semantic retrieval.

Benchmark texts (in parts of at most ``PART`` words) and documents (in passages of 64 words, every 32; of 32, 16 or 8
words, every half, for parts of at most 24, 12 or 6) are TF-IDF vectors over the benchmark's vocabulary, with document frequencies counted over the whole corpus. A
randomised SVD of all corpus passages and the benchmark's own gives a latent space: every task adds its passages'
share of A'A Omega for one random Omega, and the shares are summed in two steps. Passages whose
cosine with a benchmark part reaches ``least_cosine`` are compared word by word: the longest common
subsequence must cover ``least_lcs`` of the part, and that of its last third, taken as the answer, half of it.
Before that, a passage must hold one of the part's rarest words, so many that no subsequence is long enough without
any. Items of fewer than LEAST_WORDS words are found where their words stand in a text in unbroken order.

Texts of more than PIECE words are read in overlapping pieces, with the results of the whole text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buildtrail.llm import textnp as tn
from buildtrail.llm.keys import ident, keyed
from buildtrail.llm.session import checkpointed
from buildtrail.ship import ship

PART, STRIDE, LEAST_WORDS, RANK, EXTRA = 48, 32, 5, 128, 16
BLOCK = 1024  # parts
LEAST_STRIDE, ROWS, LARGE = 4, 1024, 64
RANGE = 1 << 18  # floats of the sketch in one piece
PIECE, OVERLAP = 1 << 15, 4 * STRIDE  # words; a passage with its surroundings is shorter than the overlap
FLOATS = 1 << 22  # of latent rows held at once
SEPARATOR = np.array([not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128) for b in range(256)])


@dataclass
class Part:
    item: int
    words: np.ndarray  # hashes


def split_parts(items: list[tuple[int, str | None]], least_words: int = LEAST_WORDS) -> list[Part]:
    """Benchmark texts in parts; texts of fewer than ``least_words`` words have none."""
    out = []
    for item, text in items:
        buf = np.frombuffer((text or "").encode(), np.uint8)
        _, _, h, _ = tn.words(tn.lower(buf), np.array([0, len(buf)]), SEPARATOR)
        n = max(1, -(-len(h) // PART))
        out += [Part(item, p) for p in np.array_split(h, n) if len(p) >= max(1, least_words)]
    return out


def blocks(items: Iterable[tuple[int, str | None]], size: int = BLOCK, least_words: int = LEAST_WORDS) -> Iterator[list[Part]]:
    """The parts of all items in lists of at most ``size``."""
    held: list[Part] = []
    for item in items:
        held += split_parts([item], least_words)
        while len(held) >= size:
            yield held[:size]
            held = held[size:]
    if held:
        yield held


def rank_of(parts: int) -> int:
    """Dimensions of the latent space: at least one for each two parts."""
    return min(parts, max(RANK, -(-parts // 2)))


def doc_words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    _, _, h, wo = tn.words(tn.lower(buf), offs, SEPARATOR)
    return h, wo


def _cells(wo: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Cut each text's words to cells of ``size``: the cell of each word, and the texts' offsets into cells."""
    n = np.diff(wo)
    co = np.concatenate([[0], np.cumsum(-(-n // size))])
    return np.repeat(co[:-1], n) + tn.spread(n) // size, co


def lookup(vocabulary: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which words are in the sorted vocabulary, and where."""
    at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
    known = np.flatnonzero(vocabulary[at] == h)
    return known, at[known]


def _sum_rows(table: np.ndarray, index: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """Sums of the table's rows at ``index`` by their (ascending) group: whole rows are added, first ones first; large groups by themselves."""
    out = np.zeros((n, table.shape[1]), table.dtype)
    count = np.bincount(group, minlength=n)
    start = np.cumsum(count) - count
    for g in np.flatnonzero(count > LARGE):
        for s in range(start[g], start[g] + count[g], ROWS):
            out[g] += table[index[s : min(s + ROWS, start[g] + count[g])]].sum(0)
    left, k = np.flatnonzero((count > 0) & (count <= LARGE)), 0
    while len(left):
        out[left] += table[index[start[left] + k]]
        k += 1
        left = left[count[left] > k]
    return out


def known_words(texts: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """texts (k, rank, text) -> (k, rank, words, at, term): each text's length in words, and places and terms of those in the vocabulary (binary, 32 bits each).

    Texts are split into words once; all that follows reads this.
    """
    shared = texts.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = tn.flat(batch.column(2))
            for i, j in tn.chunks(offs):
                h, wo = doc_words(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                known, term = lookup(shared.value, h)
                at = (known - np.repeat(wo[:-1], np.diff(wo))[known]).astype(np.uint32)
                cut = 4 * np.searchsorted(known, wo)
                binary = lambda x: pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(cut.astype(np.int32).tobytes()), pa.py_buffer(x.astype(np.uint32).tobytes())])  # noqa: B023, E731
                yield pa.RecordBatch.from_pydict({"k": batch.column(0).slice(i, j - i), "rank": batch.column(1).slice(i, j - i), "words": pa.array(np.diff(wo), pa.int64()), "at": binary(at), "term": binary(term)})

    return texts.mapInArrow(run, "k long, rank long, words long, at binary, term binary")


def _chunks(batch: pa.RecordBatch, overlap: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of ``known_words``, some pieces of texts at a time: each one's row and whether its text ends with it, the pieces' offsets in words, places (over all these pieces) and terms of known words.

    A text has a piece for each PIECE words, and each goes on for ``overlap`` words of the next.
    """
    words = batch.column(2).to_numpy(zero_copy_only=False)
    base = np.concatenate([[0], np.cumsum(words)])
    (at, cut), (term, _) = tn.flat(batch.column(3)), tn.flat(batch.column(4))
    at, term, cut = at.copy().view(np.uint32), term.copy().view(np.uint32), cut // 4
    place = at + np.repeat(base[:-1], np.diff(cut))
    pieces = np.maximum(1, -(-(words - overlap) // PIECE))
    row, start = np.repeat(np.arange(len(words)), pieces), tn.spread(pieces) * PIECE
    size = np.minimum(PIECE + overlap, words[row] - start)
    final, start = start + size == words[row], start + base[row]
    low, offs = np.searchsorted(place, start), np.concatenate([[0], np.cumsum(size)])
    n = np.searchsorted(place, start + size) - low
    for i, j in tn.chunks(offs, 2 * PIECE):
        wo = offs[i : j + 1] - offs[i]
        here = np.repeat(low[i:j], n[i:j]) + tn.spread(n[i:j])
        yield row[i:j], final[i:j], wo, place[here] + np.repeat(wo[:-1] - start[i:j], n[i:j]), term[here].astype(np.int64)


def document_frequencies(known: DataFrame, terms: int) -> np.ndarray:
    """In how many cells of 64 words each term is."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(terms, np.int64)
        for batch in batches:
            for _, _, wo, at, term in _chunks(batch):
                cell, _ = _cells(wo, 2 * STRIDE)
                pairs = np.unique(cell[at] * terms + term)
                total += np.bincount(pairs % terms, minlength=terms)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"term": pa.array(found, pa.int64()), "n": pa.array(total[found], pa.int64())})

    rows = known.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()  # a row a term
    out = np.zeros(terms, np.int64)
    out[rows["term"].to_numpy()] = rows["n"].to_numpy()
    return out


def _omega(terms: int, width: int) -> np.ndarray:
    return np.random.default_rng(3).standard_normal((terms, width), np.float32)


def gram_sketch(known: DataFrame, idf: np.ndarray, width: int) -> np.ndarray:
    """A'A Omega over all corpus passages (cells of 64 words), terms x width. Tasks' shares are summed by ranges of terms."""
    terms = len(idf)
    shared = known.sparkSession.sparkContext.broadcast(idf.astype(np.float32))
    rows, held = max(1, RANGE // width), max(1, FLOATS // (2 * STRIDE * width))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = shared.value
        omega = _omega(terms, width) * weight[:, None]
        total = np.zeros((terms, width), np.float32)
        for batch in batches:
            for _, _, wo, at, term in _chunks(batch):
                cell, _ = _cells(wo, 2 * STRIDE)
                cell = cell[at]
                s = 0
                while s < len(term):  # some cells at a time
                    e = int(np.searchsorted(cell, cell[s] + held))
                    here, t = cell[s:e] - cell[s], term[s:e]
                    along = _sum_rows(omega, t, here, int(here[-1]) + 1)
                    order = np.argsort(t, kind="stable")
                    some, group = np.unique(t[order], return_inverse=True)
                    total[some] += _sum_rows(along, here[order], group, len(some))
                    s = e
        total *= weight[:, None]
        starts = range(0, terms, rows)
        yield pa.RecordBatch.from_pydict({"start": pa.array(starts, pa.int32()), "total": pa.array([total[s : s + rows].tobytes() for s in starts], pa.binary())})

    def add(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in tables:
            for start, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = np.frombuffer(x.as_buffer(), np.float32)
                sums[start] = sums[start] + part if start in sums else part.copy()
        yield pa.RecordBatch.from_pydict({"start": pa.array(list(sums), pa.int32()), "total": pa.array([x.tobytes() for x in sums.values()], pa.binary())})

    summed = known.mapInArrow(sketch, "start int, total binary").repartition(F.col("start")).mapInArrow(add, "start int, total binary")
    out = np.zeros((terms, width))
    for row in summed.toLocalIterator():  # terms x width floats in all
        part = np.frombuffer(row["total"], np.float32).reshape(-1, width)
        out[row["start"] : row["start"] + len(part)] += part
    return out


def latent_terms(sketch: np.ndarray, rank: int) -> np.ndarray:
    """The leading eigenvectors of A'A from its one-pass sketch (terms x rank)."""
    omega = _omega(*sketch.shape).astype(float)
    q, _ = np.linalg.qr(sketch)
    core = np.linalg.lstsq((q.T @ omega).T, (q.T @ sketch).T, rcond=1e-6)[0].T
    value, vector = np.linalg.eigh((core + core.T) / 2)
    return q @ vector[:, np.argsort(-value)[:rank]]


def lcs_length(mask: dict[int, int], n: int, words: list[int]) -> int:
    """Longest common subsequence of words and a sequence of n words given by bit masks of their places."""
    full = (1 << n) - 1
    row = full
    for w in words:
        m = mask.get(w)
        if m is not None:
            hit = row & m
            row = ((row + hit) | (row - hit)) & full
    return n - row.bit_count()


def masks(words: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


def stride_of(n: int) -> int:
    """Half the words of the passages that a part of n words is compared with: no part is under 3/8 of its passage."""
    stride = STRIDE
    while stride > LEAST_STRIDE and n <= stride * 3 // 4:
        stride //= 2
    return stride


def rarest(places: list[np.ndarray], idf: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each term (by offsets) the parts among whose rarest words it is: so many, counted as often as they stand there, that a text with none of them has fewer than ``least`` of the part's words."""
    pairs = []
    for p, w in enumerate(places):
        term, n = np.unique(w, return_counts=True)
        order = np.lexsort((term, -idf[term]))
        enough = int(np.searchsorted(np.cumsum(n[order]), len(w) - least[p], "right")) + 1
        pairs.append(np.column_stack([term[order[:enough]], np.full(min(enough, len(term)), p)]))
    pair = np.concatenate(pairs)
    pair = pair[np.argsort(pair[:, 0], kind="stable")]
    return np.searchsorted(pair[:, 0], np.arange(len(idf) + 1)), pair[:, 1]


def verbatim(known: np.ndarray, doc: np.ndarray, term: np.ndarray, short: dict[int, tuple[np.ndarray, np.ndarray]], terms: int) -> tuple[np.ndarray, np.ndarray]:
    """(doc, item) once for each of the short items whose words stand next to each other there.

    short: for each length, the items' terms as one number (to the base ``terms``), sorted, and the items. At most
    BLOCK * PART terms of at most four words fit a long.
    """
    found = []
    for n, (keys, items) in short.items():
        m = len(known) - n + 1
        if m <= 0:
            continue
        code = np.zeros(m, np.int64)
        for i in range(n):
            code = code * terms + term[i : i + m]
        run = (known[n - 1 :] - known[:m] == n - 1) & (doc[n - 1 :] == doc[:m])
        low, high = np.searchsorted(keys, code[run]), np.searchsorted(keys, code[run], "right")
        hits = high - low
        found.append(np.column_stack([np.repeat(doc[:m][run], hits), items[np.repeat(low, hits) + tn.spread(hits)]]))
    pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
    return pairs[:, 0], pairs[:, 1]


def _places(terms: int, parts: list[tuple[int, list[int]]]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct terms of each part and how often each stands in it, filled up with the term after the last."""
    places = np.full((len(parts), PART), terms, np.int64)
    times = np.zeros((len(parts), PART), np.uint8)
    for p, (_, w) in enumerate(parts):
        term, n = np.unique(np.array(w, np.int64), return_counts=True)
        places[p, : len(term)], times[p, : len(term)] = term, n
    return places, times


def _candidates(sums: np.ndarray, co: np.ndarray, stride: int, vectors: np.ndarray, mine: np.ndarray, least_cosine: float, held: tuple[np.ndarray, np.ndarray, np.ndarray], terms: int, places: np.ndarray, times: np.ndarray, least: np.ndarray, rare: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[int, int, float]]:
    """(first cell, part, cosine) of the passages of two cells that reach the cosine and, with half a cell on each side,
    hold enough of the part's words: repeated words count each time they stand in the part, so this bounds the subsequence.

    held: place in its text, text and term of each word of the vocabulary. rare: for each term, the parts (of all) of
    which it is one of the rarest; a passage without any of a part's can't hold enough of it.
    """
    last = np.zeros(len(sums) + 1, bool)
    last[co[1:] - 1] = True
    passage = sums.copy()
    passage[:-1] += np.where(last[: len(sums) - 1, None], 0, sums[1:])
    size = np.linalg.norm(passage, axis=1)
    place, doc, term = held
    cells = co[doc + 1] - co[doc]
    newest = (place + stride // 2) // stride  # a word is near this passage of its text and the two before
    order = co[doc] + place // stride
    width = int((times[mine] > 0).sum(1).max())
    places, times = places[:, :width], times[:, :width]
    cut, of = rare
    telling = np.flatnonzero(cut[term + 1] > cut[term])
    for s in range(0, len(sums), ROWS):
        e = min(s + ROWS, len(sums))
        rows = s + np.flatnonzero(size[s:e] > 0)
        if not len(rows):
            continue
        cosine = (passage[rows] / size[rows, None]) @ vectors[mine].T
        holds = np.zeros((e - s, len(places)), bool)
        low, high = np.searchsorted(order[telling], [s - 2, e + 3])
        some = telling[low:high]
        for back in range(3):
            at = newest[some] - back
            cell = co[doc[some]] + at - s
            fits = (at >= 0) & (at < cells[some]) & (cell >= 0) & (cell < e - s)
            t = term[some][fits]
            n = cut[t + 1] - cut[t]
            holds[np.repeat(cell[fits], n), of[np.repeat(cut[t], n) + tn.spread(n)]] = True
        a, b = np.nonzero((cosine >= least_cosine) & holds[rows - s][:, mine])
        if not len(a):
            continue
        near = np.zeros((e - s, terms + 1), np.uint8)
        low, high = np.searchsorted(order, [s - 2, e + 3])
        for back in range(3):
            at = newest[low:high] - back
            cell = co[doc[low:high]] + at - s
            fits = (at >= 0) & (at < cells[low:high]) & (cell >= 0) & (cell < e - s)
            near[cell[fits], term[low:high][fits]] = 1
        near = near.ravel()
        for t in range(0, len(a), 1 << 14):
            x, p = a[t : t + (1 << 14)], mine[b[t : t + (1 << 14)]]
            there = near[((rows[x] - s) * (terms + 1))[:, None] + places[p]]
            there *= times[p]
            for y in np.flatnonzero(there.sum(1, dtype=np.int64) >= least[p]):
                yield int(rows[x[y]]), int(p[y]), float(cosine[x[y], b[t + y]])


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least_cosine: float = 0.15, least_lcs: float = 0.7, least_answer: float = 0.5, least_words: int = LEAST_WORDS) -> DataFrame:
    """(k, rank, item, cosine, lcs): each document and benchmark item that has a part in it, with the best values.

    Null or empty texts leak nothing; items with a null id or of fewer than ``least_words`` words are left out; equal rows
    give one row. Items of fewer than LEAST_WORDS words leak only where they stand verbatim (cosine and lcs 1).
    The benchmark is taken in blocks of BLOCK parts.
    """
    spark = docs.sparkSession
    ship(spark)
    texts = keyed(docs, id_col, text_col)
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).cast("string").alias("text")).filter("item is not null").distinct()
    found: DataFrame | None = None
    for parts in blocks(((row["item"], row["text"]) for row in items.orderBy("item", "text").toLocalIterator()), least_words=least_words):
        block = _search(texts, parts, least_cosine, least_lcs, least_answer)
        found = block if found is None else found.unionByName(block)
    if found is None:
        return spark.createDataFrame([], "k long, rank long, item long, cosine double, lcs double")
    return found.groupBy("k", "rank", "item").agg(F.max("cosine").alias("cosine"), F.max("lcs").alias("lcs"))


@dataclass
class Search:
    """What a task needs to search texts for the parts of a block."""

    terms: int
    latent: np.ndarray  # of each term, weighted
    vectors: np.ndarray  # of each part
    parts: list[tuple[int, list[int]]]  # item, terms
    rare: tuple[np.ndarray, np.ndarray]
    short: dict[int, tuple[np.ndarray, np.ndarray]]
    least_cosine: float
    least_lcs: float
    least_answer: float

    def run(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = self.parts
        whole = [masks(w) for _, w in parts]
        answers = [w[-max(1, len(w) // 3) :] for _, w in parts]
        answer_masks = [masks(w) for w in answers]
        least = np.array([self.least_lcs * len(w) for _, w in parts])
        strides = np.array([stride_of(len(w)) for _, w in parts], np.int64)
        places, times = _places(self.terms, parts)
        for batch in batches:
            out: list[tuple[int, int, float, float]] = []  # row, item, cosine, lcs
            for row, final, wo, known, term in _chunks(batch, OVERLAP):
                if not len(known):
                    continue
                doc = np.searchsorted(wo, known, "right") - 1
                out += [(int(row[d]), int(item), 1.0, 1.0) for d, item in zip(*verbatim(known, doc, term, self.short, self.terms), strict=True)]
                if not parts:
                    continue
                stride = int(strides.min())
                cell, co = _cells(wo, stride)
                sums = np.zeros((int(co[-1]), self.latent.shape[1]), np.float32)
                at = cell[known]
                for s in range(0, len(term), 1 << 13):  # bounded rows at a time
                    part = at[s : s + (1 << 13)]
                    sums[part[0] : part[-1] + 1] += _sum_rows(self.latent, term[s : s + (1 << 13)], part - part[0], int(part[-1] - part[0]) + 1)
                while True:
                    mine = np.flatnonzero(strides == stride)
                    if len(mine):
                        for c, p, cosine in _candidates(sums, co, stride, self.vectors, mine, self.least_cosine, (known - wo[doc], doc, term), self.terms, places, times, least, self.rare):
                            d = int(np.searchsorted(co, c, "right")) - 1
                            if c == co[d + 1] - 1 and not final[d]:
                                continue  # half a passage, whole in the next piece
                            start = int(wo[d]) + (c - int(co[d])) * stride
                            item, w = parts[p]
                            low, high = np.searchsorted(known, [max(int(wo[d]), start - stride // 2), min(int(wo[d + 1]), start + 2 * stride + stride // 2)])
                            near = term[low:high].tolist()
                            n = lcs_length(whole[p], len(w), near)
                            if n >= least[p] and lcs_length(answer_masks[p], len(answers[p]), near) >= self.least_answer * len(answers[p]):
                                out.append((int(row[d]), item, cosine, n / len(w)))
                    if stride == STRIDE:
                        break
                    n = np.diff(co)
                    pair = tn.spread(n) // 2
                    stride, co = 2 * stride, np.concatenate([[0], np.cumsum(-(-n // 2))])
                    sums = _sum_rows(sums, np.arange(len(sums)), np.repeat(co[:-1], n) + pair, int(co[-1]))
            at = pa.array([r for r, _, _, _ in out], pa.int64())
            yield pa.RecordBatch.from_pydict({"k": batch.column(0).take(at), "rank": batch.column(1).take(at), "item": pa.array([x[1] for x in out], pa.int64()), "cosine": pa.array([x[2] for x in out], pa.float64()), "lcs": pa.array([x[3] for x in out], pa.float64())})


def prepare(known: DataFrame, vocabulary: np.ndarray, parts: list[Part], least_cosine: float, least_lcs: float, least_answer: float) -> Search:
    """Fit the latent space of a block's parts and the corpus."""
    long = [p for p in parts if len(p.words) >= LEAST_WORDS]
    few: dict[int, list[tuple[int, int]]] = {}
    for p in parts:
        if len(p.words) < LEAST_WORDS:
            code = 0
            for t in lookup(vocabulary, p.words)[1].tolist():
                code = code * len(vocabulary) + t
            few.setdefault(len(p.words), []).append((code, p.item))
    short = {n: (np.array([c for c, _ in sorted(x)], np.int64), np.array([i for _, i in sorted(x)], np.int64)) for n, x in few.items()}
    if not long:
        nothing = np.zeros(0, np.int64)
        return Search(len(vocabulary), np.zeros((len(vocabulary), 0), np.float32), np.zeros((0, 0), np.float32), [], (nothing, nothing), short, least_cosine, least_lcs, least_answer)
    cells = known.agg(F.sum(F.ceil(F.col("words") / (2 * STRIDE)))).first()[0] or 0
    idf = np.log1p(cells / (1.0 + document_frequencies(known, len(vocabulary))))  # above 0 for every term: an item that many documents hold keeps its vector
    places = [lookup(vocabulary, p.words)[1] for p in long]
    rank = min(rank_of(len(long)), len(vocabulary))
    width = min(len(vocabulary), rank + EXTRA)
    sketch = gram_sketch(known, idf, width)
    omega = _omega(len(vocabulary), width).astype(float)
    share = cells / len(long)  # the benchmark's passages weigh as much as the corpus
    for at in places:
        np.add.at(sketch, at, share * idf[at, None] * (idf[at] @ omega[at])[None, :])
    latent = (latent_terms(sketch, rank) * idf[:, None]).astype(np.float32)
    vectors = np.array([latent[at].sum(0) for at in places])
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors = np.where(norm > 0, vectors / np.maximum(norm, 1e-12), 0).astype(np.float32)
    rare = rarest(places, idf, np.array([least_lcs * len(w) for w in places]))
    return Search(len(vocabulary), latent, vectors, [(p.item, at.tolist()) for p, at in zip(long, places, strict=True)], rare, short, least_cosine, least_lcs, least_answer)


def _search(texts: DataFrame, parts: list[Part], least_cosine: float, least_lcs: float, least_answer: float) -> DataFrame:
    vocabulary = np.unique(np.concatenate([p.words for p in parts]))
    known = checkpointed(known_words(texts, vocabulary))
    shared = texts.sparkSession.sparkContext.broadcast(prepare(known, vocabulary, parts, least_cosine, least_lcs, least_answer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from shared.value.run(batches)

    return known.mapInArrow(run, "k long, rank long, item long, cosine double, lcs double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), least_words=1)
    return found.select(ident().alias("doc_id"), F.col("item").alias("item_id"), F.round("cosine", 4).alias("cosine"), F.round("lcs", 4).alias("lcs"))
