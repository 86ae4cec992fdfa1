"""Toxic passages by maximum-scoring segments.

A token's score is the log-odds of its most specific telling feature (the word, else its longest prefix with a known rate) between
toxic and clean training texts, less a constant. Words and prefixes of each length are distributions of their own, each under a
Dirichlet prior over its vocabulary that has the texts' own shares and the weight of ``PRIOR`` times their tokens; features of toxic
and of clean texts tell alike. Unknown tokens score minus that
constant. A linear-time scan finds all maximal scoring segments of a text. Their scores are calibrated
by extreme-value statistics: lambda solves E[exp(lambda s)] = 1 over tokens of clean texts, and K is the
maximum-likelihood value for the best segments of clean texts, so a segment of score S is met
K N exp(-lambda S) times by chance in N tokens. A text's statistics are its best segment's and the sum of
all significant segments' normalised scores; a logistic curve makes them a score. Calibration and curve are fitted on scores that each
training text gets from the other texts' odds (``FOLDS`` parts by hash of text), so that no text is judged by odds it gave.

Only labelled texts of a bounded sample (``most`` rows, in hash order) are learned from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from buildtrail.llm import textnp as tn
from buildtrail.llm.session import checkpointed
from buildtrail.ship import ship

PREFIXES = (4, 5, 6, 7, 8)
PRIOR, SHIFT, LEAST_Z, FOLDS = 0.02, 1.5, 3.0, 5
SEPARATOR = np.array([not (65 <= b <= 90 or 97 <= b <= 122 or b >= 128) for b in range(256)])


def fold(id_col: str) -> Column:
    """The remainder by which a row is held out (0) or may be learned from."""
    return F.crc32(F.col(id_col).cast("string")) % 5


def tokens(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, texts' offsets; then, for distinct tokens: features (tokens x kinds, 0 for none), and each token's place among them."""
    small = tn.lower(buf)
    starts, ends, h, wo = tn.words(small, offs, SEPARATOR)
    unique, first, of = np.unique(h, return_index=True, return_inverse=True)
    features = np.zeros((len(unique), 1 + len(PREFIXES)), np.uint64)
    features[:, 0] = tn.mix(unique + np.uint64(1))
    s, size = starts[first], (ends - starts)[first]
    base = 0
    order = np.argsort(s, kind="stable")
    while base < len(order):  # hashes of prefixes, part by part of a long buffer
        stop = max(base + 1, int(np.searchsorted(s[order], s[order[base]] + tn.CHUNK)))
        rows = order[base:stop]
        low = s[rows[0]]
        sums = tn.prefix_sums(small[low : s[rows[-1]] + PREFIXES[-1]])
        for c, n in enumerate(PREFIXES):
            fit = rows[size[rows] > n]
            features[fit, 1 + c] = tn.mix(tn.span_hash(sums, s[fit] - low, s[fit] - low + n) + np.uint64(100 + n))
        base = stop
    return starts, ends, wo, unique, features, of


def maximal_segments(before: np.ndarray, after: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments, from the cumulative scores before and after each positive token: first, last, score."""
    found: list[tuple[float, float, int, int]] = []
    for i, (low, high) in enumerate(zip(before.tolist(), after.tolist(), strict=True)):
        first = i
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][0] >= low:
                j -= 1
            if j < 0 or found[j][1] >= high:
                found.append((low, high, first, i))
                break
            low, first = found[j][0], found[j][2]
            del found[j:]
    return [(a, b, high - low) for low, high, a, b in found]


@dataclass
class Model:
    features: np.ndarray  # sorted
    log_odds: np.ndarray
    rate: float = 1.0  # lambda
    k: float = 1.0
    weights: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def token_scores(self, features: np.ndarray) -> np.ndarray:
        if not len(self.features):
            return np.full(len(features), -SHIFT)
        at = np.minimum(np.searchsorted(self.features, features), len(self.features) - 1)
        known = self.features[at] == features
        best = np.where(known[:, 0], 0, known.shape[1] - 1 - np.argmax(known[:, ::-1], axis=1))  # the word, else its longest known prefix
        rows = np.arange(len(features))
        return np.where(known[rows, best], self.log_odds[at[rows, best]], 0.0) - SHIFT

    def segments(self, buf: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, np.ndarray, list[tuple[int, int, float]]]]:
        """For each text: its number of tokens, its token scores, its maximal segments (first byte, end byte, score)."""
        starts, ends, wo, _, features, of = tokens(buf, offs)
        scores = self.token_scores(features)[of] if len(of) else np.zeros(0)
        total = np.concatenate([[0.0], np.cumsum(scores)])
        hits = np.flatnonzero(scores > 0)
        cut = np.searchsorted(hits, wo)
        for i in range(len(offs) - 1):
            mine = hits[cut[i] : cut[i + 1]]
            found = maximal_segments(total[mine], total[mine + 1]) if len(mine) else []
            yield int(wo[i + 1] - wo[i]), scores[wo[i] : wo[i + 1]], [(int(starts[mine[a]] - offs[i]), int(ends[mine[b]] - offs[i]), s) for a, b, s in found]

    def normal(self, n: int, score: float) -> float:
        """Minus the log of the number of such segments expected by chance among n tokens."""
        return self.rate * score - float(np.log(max(self.k * max(n, 1), 1e-12)))

    def statistics(self, n: int, scores: list[float]) -> tuple[float, float]:
        bits = [max(0.0, self.normal(n, s)) for s in scores]
        return float(np.log1p(max(bits, default=0.0))), float(np.log1p(sum(bits)))

    def probability(self, best: float, total: float) -> float:
        w = self.weights
        return float(1 / (1 + np.exp(-np.clip(w[0] + w[1] * best + w[2] * total, -30, 30))))


def training_texts(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: int) -> DataFrame:
    """(text, y, part) of at most ``most`` labelled ids outside the held-out fold; equal texts with one label once, and in one part."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).filter(fold(id_col) != 0)
    chosen = known.groupBy(F.col(id_col).alias("id")).agg((F.max(label_col) > 0).cast("int").alias("y")).orderBy(F.xxhash64("id"), "id").limit(most)
    joined = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "id")  # most rows at most
    return joined.withColumn("h", F.xxhash64("text")).dropDuplicates(["h", "y"]).select("text", "y", F.pmod("h", F.lit(FOLDS)).cast("int").alias("part"))


def _counts(texts: DataFrame) -> DataFrame:
    """(f, kind, sums: for each part n1, n0, d1, d0): tokens and texts of both labels that hold each feature; f = 0: all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = tn.flat(batch.column(0))
            y, part = (batch.column(c).to_numpy(zero_copy_only=False) for c in (1, 2))
            for i, j in tn.chunks(offs):
                _, _, wo, _, features, of = tokens(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                doc = np.repeat(np.arange(j - i), np.diff(wo))
                pairs, times = np.unique(doc * (len(features) + 1) + of, return_counts=True)
                doc, of = pairs // (len(features) + 1), pairs % (len(features) + 1)
                f, d, n = features[of].ravel(), np.repeat(doc, features.shape[1]), np.repeat(times, features.shape[1])
                kind = np.tile(np.arange(features.shape[1]), len(doc))
                f, d, n, kind = f[f > 0], d[f > 0], n[f > 0], kind[f > 0]
                order = np.lexsort((d, f))
                f, d, n, kind = f[order], d[order], n[order], kind[order]
                if not len(f):
                    continue
                new = np.flatnonzero(np.concatenate([[True], (f[1:] != f[:-1]) | (d[1:] != d[:-1])]))
                f, d, n, kind = f[new], d[new], np.add.reduceat(n, new), kind[new]
                f, d, n, kind = np.concatenate([f, np.zeros(j - i, np.uint64)]), np.concatenate([d, np.arange(j - i)]), np.concatenate([n, np.diff(wo)]), np.concatenate([kind, np.full(j - i, -1)])
                yield pa.RecordBatch.from_pydict({"f": pa.array(f.view(np.int64)), "kind": pa.array(kind.astype(np.int32)), "y": pa.array(y[i:j][d].astype(np.int32)), "part": pa.array(part[i:j][d].astype(np.int32)), "n": pa.array(n.astype(np.int64))})

    sums = []
    for k in range(FOLDS):
        mine, toxic = F.col("part") == k, F.col("y") == 1
        of = lambda which, what: F.sum(F.when(which, what).otherwise(0))
        sums.append(F.struct(of(mine & toxic, F.col("n")).alias("n1"), of(mine & ~toxic, F.col("n")).alias("n0"), F.count_if(mine & toxic).alias("d1"), F.count_if(mine & ~toxic).alias("d0")))
    return texts.mapInArrow(count, "f long, kind int, y int, part int, n long").groupBy("f", "kind").agg(F.array(*sums).alias("sums"))


def _odds(counted: DataFrame) -> list[Model]:
    """For each part the odds of all other texts, then those of all texts: of a bounded sample, of which only telling features are sent."""
    sets = []
    for k in range(FOLDS + 1):
        total = lambda c: sum((F.col("sums")[i][c] for i in range(FOLDS) if i != k), F.lit(0))  # noqa: E731, B023
        sets.append(F.struct(F.lit(k).alias("without"), *(total(c).alias(c) for c in ("n1", "n0", "d1", "d0"))))
    each = counted.select("f", "kind", F.explode(F.array(*sets)).alias("c")).select("f", "kind", "c.*").filter("d1 + d0 > 0")
    all_texts = each.filter("f = 0").select("without", F.col("d1").alias("t1"), F.col("d0").alias("t0"))  # a row a part
    each = each.filter("f <> 0")
    whole = each.groupBy("without", "kind").agg(F.sum("n1").alias("m1"), F.sum("n0").alias("m0"))  # a row a part and kind
    prior, priors = PRIOR * (F.col("n1") + F.col("n0")), PRIOR * (F.col("m1") + F.col("m0"))  # the latter is the former's sum over the vocabulary
    side = lambda n: F.log((F.col(f"n{n}") + prior) / (F.col(f"m{n}") + priors))
    share = lambda n: F.log((F.col(f"d{n}") + 0.5) / (F.col(f"t{n}") - F.col(f"d{n}") + 0.5))
    z = (share(1) - share(0)) / F.sqrt(1 / (F.col("d1") + 0.5) + 1 / (F.col("d0") + 0.5))  # by texts that hold it, as words come in bursts
    telling = each.join(F.broadcast(whole), ["without", "kind"]).join(F.broadcast(all_texts), "without").filter("m1 > 0 and m0 > 0").withColumn("odds", side(1) - side(0)).filter(F.abs(z) > LEAST_Z)
    rows = telling.select("without", "f", "odds").toPandas()
    models = []
    for k in range(FOLDS + 1):
        mine = rows[rows["without"] == k]
        features = mine["f"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(features)
        models.append(Model(features[order], mine["odds"].to_numpy(float)[order]))
    return models


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = 20_000) -> Model:
    """Learn a Model. Null labels and ids are left out; without texts of both labels every score is 0.5 or the labels' share."""
    spark = docs.sparkSession
    ship(spark)
    texts = checkpointed(training_texts(docs, labels, id_col, text_col, label_col, most))
    counted = checkpointed(_counts(texts))
    sums = counted.filter("f = 0").first()
    toxic, clean = (0, 0) if sums is None else (sum(x[c] for x in sums["sums"]) for c in ("d1", "d0"))
    share = toxic / (toxic + clean) if toxic + clean else 0.5
    base = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    if not toxic or not clean:
        return Model(np.zeros(0, np.uint64), np.zeros(0), weights=(base, 0.0, 0.0))
    *others, model = _odds(counted)
    shared = spark.sparkContext.broadcast(others)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(FOLDS):
                batch = whole.filter(pc.equal(whole.column(2), k))
                buf, offs = tn.flat(batch.column(0))
                for i, j in tn.chunks(offs):
                    sizes, seg, values, times = [], [], [], []
                    for n, scores, found in shared.value[k].segments(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]):
                        sizes.append(n)
                        seg.append([s for _, _, s in found])
                        v, c = np.unique(np.round(scores, 1), return_counts=True)
                        values.append(v)
                        times.append(c)
                    yield pa.RecordBatch.from_pydict({"y": batch.column(1).slice(i, j - i), "n": pa.array(sizes, pa.int64()), "scores": pa.array(seg, pa.list_(pa.float64())), "value": pa.array(values, pa.list_(pa.float64())), "times": pa.array(times, pa.list_(pa.int64()))})

    scanned = checkpointed(texts.mapInArrow(scan, "y int, n long, scores array<double>, value array<double>, times array<long>"))
    background = scanned.filter("y = 0").select(F.explode(F.arrays_zip("value", "times")).alias("x")).groupBy("x.value").agg(F.sum("x.times").alias("times")).orderBy("value").toPandas()  # scores in tenths
    per_text = scanned.select("y", "n", "scores").toPandas()  # at most ``most`` rows
    value, weight = background["value"].to_numpy(float), background["times"].to_numpy(float)
    model.rate = _rate(value, weight / weight.sum()) if len(value) and weight.sum() else 1.0
    best = [max(s, default=0.0) for s in per_text["scores"].map(list)]
    clean_best = [(n, b) for y, n, b in zip(per_text["y"], per_text["n"], best, strict=True) if y == 0 and b > 0]
    if clean_best:
        n, b = (np.array(x, float) for x in zip(*clean_best, strict=True))
        model.k = len(clean_best) / float((n * np.exp(-model.rate * b)).sum())
    x = np.array([model.statistics(n, list(s)) for n, s in zip(per_text["n"], per_text["scores"], strict=True)])
    model.weights = _logistic(x, per_text["y"].to_numpy(float))
    return model


def _rate(value: np.ndarray, share: np.ndarray) -> float:
    """The positive root of E[exp(rate value)] = 1, where the mean is negative and some value positive; else 1."""
    if (value * share).sum() >= 0 or value.max() <= 0:
        return 1.0
    low, high = 1e-6, 1.0
    grow = lambda r: float((share * np.exp(np.minimum(r * value, 600))).sum()) - 1
    while grow(high) < 0 and high < 1e6:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (low, mid) if grow(mid) > 0 else (mid, high)
    return low


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Newton steps with a small ridge."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        ridge = np.diag([1e-6, 1e-2, 1e-2])
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + ridge, a.T @ (y - p) - ridge @ w)
        w += np.clip(step, -5, 5)
    return tuple(float(v) for v in w)


def score(docs: DataFrame, model: Model, text_col: str = "text", expected: float = 0.05) -> DataFrame:
    """docs with score (0 to 1) and passages: an array of {start, end (bytes of the UTF-8 text), score, expected}.

    Passages are all maximal segments expected fewer than ``expected`` times by chance in such a text. Null and
    empty texts have none and the score of a text without any. A column named score or passages is replaced.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("score", "passages")
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            buf, offs = tn.flat(batch.column(place))
            for i, j in tn.chunks(offs):
                values, spans = [], []
                for n, _, found in m.segments(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]):
                    values.append(m.probability(*m.statistics(n, [s for _, _, s in found])))
                    spans.append([{"start": a, "end": b, "score": s, "expected": float(np.exp(-m.normal(n, s)))} for a, b, s in found if np.exp(-m.normal(n, s)) < expected])
                part = batch.slice(i, j - i)
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())]))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(values, pa.float64()), pa.array(spans, kind)], names=[*batch.schema.names, "score", "passages"])

    from pyspark.sql.types import ArrayType, DoubleType, LongType, StructType

    span = StructType().add("start", LongType()).add("end", LongType()).add("score", DoubleType()).add("expected", DoubleType())
    schema = StructType(list(docs.schema.fields)).add("score", DoubleType()).add("passages", ArrayType(span))
    return docs.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs, model)
    return scored.select("doc_id", F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))
