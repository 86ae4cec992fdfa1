import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from buildtrail.llm import components, jaccard_join, line_dedup, substring_dedup, suffix_dedup
from buildtrail.llm.keys import LAST

from . import brute

SCHEMA = "doc_id long, text string, k string, rank int, start int"


def corpus(seed, n=60):
    """Copies, near copies, shared passages, nulls, empties, a very long word, accents, ties and repeated rows."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdéß") for _ in range(r.randint(1, 6))) for _ in range(80)]
    say = lambda k: " ".join(r.choice(words) for _ in range(k))
    passage = say(30)
    texts = []
    for _ in range(n):
        kind = r.random()
        if kind < 0.3 and texts:
            texts.append(r.choice(texts))
        elif kind < 0.6 and texts and texts[-1]:
            w = r.choice([t for t in texts if t] or [say(9)]).split(" ")
            w[r.randrange(len(w))] = r.choice(words)
            texts.append(" ".join(w))
        elif kind < 0.75:
            texts.append(f"{say(r.randint(0, 20))}\n{passage}\t{say(r.randint(0, 20))}")
        else:
            texts.append(say(r.randint(0, 90)))
    texts += [None, "", " ", "x" * 5000, "x" * 5000 + "y", passage.upper()]
    rows = [(i, t) for i, t in enumerate(texts)]
    return [*rows, rows[3], rows[3], (5, "another text of id 5"), (None, texts[0]), (None, None)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "extra", 7, 1) for i, t in rows], SCHEMA).repartition(3)


def same(a, b):
    assert sorted(a, key=repr) == sorted(b, key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_suffix_arrays(spark, seed):
    rows = corpus(seed)
    got = suffix_dedup.remove_repeats(frame(spark, rows), window=40, gram=12).collect()
    same([(r[0], r[1], r[2], r[3], bytes(r[4])) for r in got], brute.repeated_bytes(rows, 40))


def test_suffix_query_of_planted_passages(spark, tmp_path):
    """Passages of over 50 words: from 400 bytes on they go from every document, the first as well; a shorter one and the rest stay."""
    r = random.Random(6)
    say = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    long, short = say(60)[:399] + "x", say(60)[:398] + "y"
    around = lambda i, passage: f"{say(20)}{i}{passage}{chr(65 + i)}{say(20)}"
    rows = [(i, around(i, long)) for i in range(3)] + [(i, around(i, short)) for i in range(3, 6)]
    rows += [(6, say(90)), (7, f"{say(9)}é{long}é{say(9)}{long}"), (8, None)]
    assert len(long.split()) > 50 < len(short.split())
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(x) for x in suffix_dedup.query(spark, str(tmp_path)).collect()]
    same(got, [(*x[:4], hashlib.sha256(x[4]).hexdigest()) for x in brute.repeated_bytes(rows, 400)])
    assert {i: (removed, spans) for i, _, removed, spans, _ in got} == {i: (400, 1) for i in range(3)} | {7: (800, 2)} | {i: (0, 0) for i in (3, 4, 5, 6, 8)}
    assert all(n_bytes == len((dict(rows)[i] or "").encode()) for i, n_bytes, *_ in got)


def test_suffix_array_levels_of_one_anchor(spark):
    r = random.Random(4)
    core = "".join(r.choice("ab") for _ in range(60))
    rows = [(i, "".join(r.choice("cd") for _ in range(8)) + core + "".join(r.choice("cd") for _ in range(8))) for i in range(40)]
    got = suffix_dedup.remove_repeats(frame(spark, rows), window=62, gram=12).collect()
    same([(x[0], x[1], x[2], x[3], bytes(x[4])) for x in got], brute.repeated_bytes(rows, 62))


def test_suffix_array_family_in_small_batches():
    """Batches of 3 and 7 make several levels and merges; each window that two fragments share is found, and no other."""
    window, reach = 12, 8
    for seed in range(30):
        r = np.random.default_rng(seed)
        n = int(r.integers(2, 40))
        texts = [bytes(r.choice(list(b"ab"), window + reach)) for _ in range(n)]
        before = r.integers(0, reach + 1, n)
        key = r.integers(0, 3, n).astype(np.uint64)
        after = np.zeros((n, window), np.uint8)
        back = np.zeros((n, reach), np.uint8)
        for i, (t, b) in enumerate(zip(texts, before, strict=True)):
            a = np.frombuffer(t[b : b + window], np.uint8)
            after[i, : len(a)] = a
            back[i, :b] = np.frombuffer(t[:b][::-1], np.uint8)
        n_after = np.array([len(t[b : b + window]) for t, b in zip(texts, before, strict=True)])
        for batch in (3, 7):
            family = suffix_dedup.Family(suffix_dedup.Fragments(key, after, n_after, back, before), window)
            for s in range(0, n, batch):
                family.add(np.arange(s, min(n, s + batch)))
            sizes = [len(x) for x in family.levels]
            assert sorted(np.concatenate(family.levels)) == list(range(n)) and sizes == sorted(sizes, reverse=True)
            assert all(list(family.f.forward[x]) == sorted(family.f.forward[x]) for x in family.levels)
            got = family.repeated()
            for i in range(n):
                for s in range(reach + 1):
                    piece = lambda k: texts[k][before[k] - s : before[k] - s + window]  # noqa: B023, E731
                    fits = lambda k: s <= before[k] and before[k] - s + window <= before[k] + n_after[k]  # noqa: B023, E731
                    want = fits(i) and any(k != i and key[k] == key[i] and fits(k) and piece(k) == piece(i) for k in range(n))
                    assert got[i, s] == want


def test_texts_longer_than_a_chunk(spark):
    r = np.random.default_rng(3)
    long = "".join(r.choice(list("abcdefgh "), (1 << 20) + 5000))
    rows = [(0, long), (1, long[(1 << 20) - 300 : (1 << 20) + 900] + "z"), (2, "y" + long[:700]), (3, None)]
    got = suffix_dedup.remove_repeats(frame(spark, rows)).collect()
    same([(x[0], x[1], x[2], x[3], bytes(x[4])) for x in got], brute.repeated_bytes(rows, 400))
    same([tuple(x) for x in substring_dedup.remove_repeats(frame(spark, rows)).collect()], brute.repeated_words(rows, 13))
    found = jaccard_join.classes(frame(spark, rows)).collect()
    same([(x["rank"], x["n"], x["root"]["rank"]) for x in found], brute.jaccard_classes(rows))


def test_fm_index_streams_what_it_doesn_t_hold():
    r = np.random.default_rng(5)
    for _ in range(20):
        lengths = r.integers(0, 30, 12)
        codes = r.integers(1, 5, int(lengths.sum()))
        index = substring_dedup.FMIndex(codes, lengths, 4)
        owner = r.permutation(12).astype(np.int64)
        ask = r.integers(0, 30, 6)
        words = r.integers(1, 5, int(ask.sum()))
        cut = lambda c, n: [tuple(x) for x in np.split(c, np.cumsum(n)[:-1])]
        least = {}
        for o, t in zip(owner, cut(codes, lengths), strict=True):
            for i in range(len(t) - 3):
                least[t[i : i + 4]] = min(o, least.get(t[i : i + 4], 99))
        want = [least.get(t[i : i + 4], np.iinfo(np.int64).max) for t in cut(words, ask) for i in range(len(t) - 3)]
        assert list(substring_dedup.search(index, owner, words, ask, 4)) == want


@pytest.mark.parametrize("seed", [1, 2])
def test_fm_index(spark, seed):
    rows = corpus(seed)
    got = substring_dedup.remove_repeats(frame(spark, rows), window=6).collect()
    same([tuple(r) for r in got], brute.repeated_words(rows, 6))


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_classes(spark, seed):
    rows = corpus(seed, 120)
    found = jaccard_join.classes(frame(spark, rows)).collect()
    got = [(None if r["rank"] == LAST else r["rank"], r["n"], float("inf") if r["root"]["rank"] == LAST else r["root"]["rank"]) for r in found]
    same(got, brute.jaccard_classes(rows))


def test_jaccard_classes_of_a_large_group_of_near_copies(spark):
    """Members differ from one text in one to six places, so links, chains of links and near misses all occur."""
    r = random.Random(7)
    base = [f"w{i}" for i in range(90)]
    rows = []
    for i in range(260):
        w = list(base)
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = r.choice("xyz")
        rows.append((i, " ".join(w + [f"tail{i % 9}"] * (i % 4))))
    found = jaccard_join.classes(frame(spark, rows)).collect()
    same([(r["rank"], r["n"], r["root"]["rank"]) for r in found], brute.jaccard_classes(rows))


def test_jaccard_query_of_null_ids(spark, tmp_path):
    spark.createDataFrame([(None, "a b c d e f g"), (4, "h i j"), (None, "h i j"), (5, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in jaccard_join.query(spark, str(tmp_path)).collect()]
    same(got, [(None, 3, None), (4, 1, 4), (None, 1, 4), (5, 0, 5)])


@pytest.mark.parametrize("seed", [1, 2])
def test_lines(spark, seed):
    r = random.Random(seed)
    line = lambda: "".join(r.choice("abé ") for _ in range(r.choice([0, 3, 17, 18, 40, 200])))
    pool = [line() for _ in range(12)]

    def edited(s):
        i = r.randrange(len(s) + 1)
        return r.choice([s[:i] + s[i + 1 :], s[:i] + "x" + s[i:], s[:i] + "y" + s[i + 1 :]])

    rows = [(i, "\n".join(r.choice([r.choice(pool), edited(r.choice(pool)), line()]) for _ in range(r.randint(1, 5)))) for i in range(30)]
    rows += [(30, None), (31, ""), (None, rows[0][1]), (3, rows[3][1])]
    df = spark.createDataFrame([(i, t, "x", 5) for i, t in rows], "doc_id long, text string, n_removed string, line int")
    out = line_dedup.dedup_lines(df, near_chars=16)
    assert out.columns == ["doc_id", "text", "line", "n_lines", "n_removed"]
    got = {(x["doc_id"], x["text"]) for x in out.filter(F.col("text").isNotNull()).collect()}
    assert got == set(brute.kept_lines(rows, 16))
    assert out.count() == len(rows)


def test_lines_under_the_bound_lead_no_group(spark):
    rows = [(0, "Photo 1 of many\nPhoto 11 of many\nPhoto 21 of many")]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), near_chars=16).first()
    assert (got["doc_id"], got["text"]) == brute.kept_lines(rows, 16)[0] == (0, "Photo 1 of many\nPhoto 11 of many")


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert suffix_dedup.remove_repeats(empty).count() == 0
    assert substring_dedup.remove_repeats(empty).count() == 0
    assert jaccard_join.classes(empty).count() == 0
    assert line_dedup.dedup_lines(empty).count() == 0


def test_components_end_whole_or_with_an_error(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(5)], "u long, v long")
    assert {tuple(r) for r in components.connected_components(edges).collect()} == {(i, 0) for i in range(6)}
    with pytest.raises(RuntimeError):
        components.connected_components(edges, most=1)
