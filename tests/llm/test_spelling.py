import collections
import random

import numpy as np

from buildtrail.llm import spelling

from .brute import within_one_edit


def rows(seed=1):
    r = random.Random(seed)
    stems = ["".join(r.choice("abcdeéßÄ×") for _ in range(r.randint(4, 12))) for _ in range(60)]
    words = list(stems)
    for s in stems:  # chains of near words
        for _ in range(r.randint(0, 4)):
            at = r.randrange(len(s))
            s = r.choice([s[:at] + s[at + 1 :], s[:at] + r.choice("abcÿz") + s[at:], s[:at] + r.choice("abcxyz") + s[at + 1 :]])
            words.append(s)
    long = "abcdefghij" * 400
    weight = [r.choice([1, 2, 5, 20]) for _ in words]
    docs = [(i, " ".join(r.choices(words, weight, k=r.randint(0, 60))).replace("a", "A", 3) + r.choice(["", "!", "\n", " 日本"])) for i in range(120)]
    docs += [(1000 + k, f"{long} {long[:2000]}x{long[2000:]} {long[:-1]}") for k in range(4)]
    docs += [(900, None), (901, ""), (902, "1 2 3 --"), (None, " ".join(words)), docs[5], docs[5], (7, "another text " + words[0])]
    return docs


def plain(docs, ratio=2):
    counts = collections.Counter()
    for i, t in docs:
        for run in spelling.RUN.findall((t or "").translate(spelling.LOWER)):
            counts[spelling.slipped(i, run)] += 1
    n = {w: k for w, k in counts.items() if len(w) >= 5 and k >= 3}
    near = {w: [v for v in n if v != w and within_one_edit(v, w)] for w in n}
    form = {}
    for w, others in near.items():
        if others:
            best = min(others, key=lambda v: (-n[v], v))
            if n[best] >= ratio * n[w]:
                form[w] = best
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(near[w]), n.get(form.get(w))))
    return out


def frame(spark, docs):
    return spark.createDataFrame([(i, t, 1, 2, "x") for i, t in docs], "doc_id long, text string, n int, word int, other string").repartition(3)


def found(df):
    rows = df.select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len(rows) == len({r["word"] for r in rows})
    return {tuple(r) for r in rows}


def test_equals_brute_force(spark, monkeypatch):
    docs = rows()
    want = plain(docs)
    assert any(x[1] for x in want) and any(x[2] not in (x[0], x[1]) for x in want) and any(len(x[0]) > 3000 and x[4] for x in want)
    assert found(spelling.spelling_forms(frame(spark, docs))) == want
    monkeypatch.setattr(spelling, "FILTER_BYTES", 64)  # several filters a length and several passes
    monkeypatch.setattr(spelling, "HELD", 10)
    assert found(spelling.spelling_forms(frame(spark, docs))) == want


def test_empty_tables(spark):
    assert spelling.spelling_forms(frame(spark, rows()[:1]).limit(0)).count() == 0
    assert spelling.spelling_forms(frame(spark, [(1, None), (2, "one two")])).count() == 0


def test_runs_are_never_cut(monkeypatch):
    monkeypatch.setattr(spelling, "PIECE", 7)
    text = "ab cdefghijklmnop, Qé rstuv" * 3
    assert [w for some in spelling._runs(text) for w in some] == spelling.RUN.findall(text.translate(spelling.LOWER))


def test_edit_hashes():
    words = ["abcde", "aabbé", "zzzzz"]
    alphabet = np.sort(np.array([ord(c) for c in "abcdeéz"], np.uint32))
    got = set()
    for length, h, w, at, c in spelling.edits(spelling._code_points(words), alphabet):
        for x, i, j, y in zip(h.tolist(), w.tolist(), at.tolist(), c.tolist(), strict=True):
            other = words[i][:j] + (chr(y) if y >= 0 else "") + words[i][j + 1 :]
            assert len(other) == length and spelling.hashes(spelling._code_points([other]))[0] == x
            got.add((words[i], other))
    want = {(w, w[:j] + w[j + 1 :]) for w in words for j in range(5)} | {(w, w[:j] + c + w[j + 1 :]) for w in words for j in range(5) for c in "abcdeéz" if c > w[j]}
    assert got == want


def test_filter_holds_all_and_little_else():
    r = np.random.default_rng(2)
    h = r.integers(0, 1 << 63, 40_000).astype(np.uint64)
    lanes = np.zeros((spelling.Filter.size(20_000), spelling.LANES), np.uint32)
    block, low = spelling.Filter.places(h[:20_000], len(lanes))
    for k in range(spelling.LANES):
        np.bitwise_or.at(lanes[:, k], block, spelling.Filter.bits(low, k))
    hit = spelling.Filter(lanes).may_hold(h)
    assert np.array_equal(hit[:20_000], np.arange(20_000)) and len(hit) - 20_000 < 200


def test_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    got = con.execute(spelling.SQL)
    names = [d[0] for d in got.description]
    want = {tuple(dict(zip(names, r, strict=True))[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in got.fetchall()}
    assert found(spelling.query(spark, "/root/testdata/sf0.001")) == want
