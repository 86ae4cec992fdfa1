import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from buildtrail.llm import chat_format, decontaminate, html_extract, packing, toxicity, vector_search

TOXIC = ["idiot", "trash", "scum"]


def texts(seed, n):
    r = np.random.default_rng(seed)
    words = ["".join(r.choice(list("abcdefgh"), r.integers(3, 8))) for _ in range(300)]
    out = []
    for i in range(n):
        w = list(r.choice(words, r.integers(5, 80)))
        y = int(i % 5 == 0)
        for _ in range(4 * y):
            w.insert(int(r.integers(0, len(w))), str(r.choice(TOXIC)))
        out.append((i, " ".join(w), y))
    return out


def test_toxicity_held_out(spark):
    rows = texts(1, 400)
    docs = spark.createDataFrame([(i, t, 1.0) for i, t, _ in rows] + [(900, None, 1.0), (901, "", 1.0), (3, rows[3][1], 1.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(7, None), (None, 1)], "doc_id long, toxic int")
    out = toxicity.score(docs, toxicity.fit(docs, labels)).withColumn("held", toxicity.fold("doc_id") == 0).collect()
    assert len(out) == 403
    by = {r["doc_id"]: r for r in out}
    held = [i for i, _, _ in rows if by[i]["held"]]
    truth = {i: y for i, _, y in rows}
    assert np.mean([(by[i]["score"] >= 0.5) == truth[i] for i in held]) > 0.95
    assert by[900]["score"] == by[901]["score"] < 0.5 and by[900]["passages"] == []
    passages = [rows[i][1].encode()[p["start"] : p["end"]].decode() for i in held for p in by[i]["passages"]]
    assert passages and all(any(w in p for w in TOXIC) for p in passages)


def test_toxicity_odds_by_definition(spark):
    """Informative Dirichlet odds of words and prefixes, recounted plainly, for all texts and without each part."""
    rows = texts(5, 200)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    training = toxicity.training_texts(docs, labels, "doc_id", "text", "toxic", 1000)
    models = toxicity._odds(toxicity._counts(training))
    got = training.collect()
    assert len(models) == toxicity.FOLDS + 1 and {x["part"] for x in got} == set(range(toxicity.FOLDS))
    for k in (0, 3, toxicity.FOLDS):
        n, m, d, v = {}, {}, {}, {}
        for x in got:
            if x["part"] == k:
                continue
            words = x["text"].lower().split()
            for kind in (0, *toxicity.PREFIXES):
                mine = [w[:kind] if kind else w for w in words if len(w) > kind]
                for w in mine:
                    n[kind, w, x["y"]] = n.get((kind, w, x["y"]), 0) + 1
                    m[kind, x["y"]] = m.get((kind, x["y"]), 0) + 1
                for w in set(mine):
                    d[kind, w, x["y"]] = d.get((kind, w, x["y"]), 0) + 1
                    v[kind, w] = True
        want = []
        for kind, w in v:
            c = toxicity.PRIOR
            a, p = c * (n.get((kind, w, 1), 0) + n.get((kind, w, 0), 0)), c * (m.get((kind, 1), 0) + m.get((kind, 0), 0))
            odds = np.log((n.get((kind, w, 1), 0) + a) / (m[kind, 1] + p)) - np.log((n.get((kind, w, 0), 0) + a) / (m[kind, 0] + p))
            d1, d0 = d.get((kind, w, 1), 0), d.get((kind, w, 0), 0)
            t = [sum(x["y"] == y and x["part"] != k for x in got) for y in (0, 1)]
            z = np.log((d1 + 0.5) / (t[1] - d1 + 0.5)) - np.log((d0 + 0.5) / (t[0] - d0 + 0.5))
            if abs(z) / np.sqrt(1 / (d1 + 0.5) + 1 / (d0 + 0.5)) > toxicity.LEAST_Z:
                want.append(odds)
        assert len(want) and np.allclose(sorted(models[k].log_odds), sorted(want))


def test_toxicity_takes_the_word_before_its_prefixes():
    buf, offs = np.frombuffer(b"trashcan trashy tree", np.uint8), np.array([0, 20])
    _, _, _, _, features, of = toxicity.tokens(buf, offs)
    can, trashy, tree = features[of]
    assert can[2] == trashy[2] > 0  # the prefix trash
    known = np.array([can[0], can[2]], np.uint64)
    order = np.argsort(known)
    model = toxicity.Model(known[order], np.array([-2.0, 5.0])[order])
    assert (model.token_scores(features)[of] + toxicity.SHIFT).tolist() == [-2.0, 5.0, 0.0]


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(docs, model).first()["score"] == 0.5
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_pipeline_without_labels_keeps_documents(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    spark.createDataFrame([(1, None)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).count() == 2


def test_maximal_segments_are_all_maximal():
    r = np.random.default_rng(2)
    for _ in range(50):
        s = r.normal(-0.3, 1, 12)
        total = np.concatenate([[0], np.cumsum(s)])
        hits = np.flatnonzero(s > 0)
        got = [(int(hits[a]), int(hits[b])) for a, b, _ in toxicity.maximal_segments(total[hits], total[hits + 1])]

        def divide(lo, hi):  # by definition: the best segment, then what is left and right of it
            best = max(((total[j + 1] - total[i], -(j - i), i, j) for i in range(lo, hi) for j in range(i, hi)), default=(0,))
            if best[0] <= 0:
                return []
            return divide(lo, best[2]) + [(best[2], best[3])] + divide(best[3] + 1, hi)

        assert got == divide(0, len(s))


def test_decontamination(spark):
    rows = texts(3, 200)
    items = [(i, " ".join(t.split()[:40])) for i, t, _ in texts(9, 30)] + [(50, None), (51, "few words")]
    r = np.random.default_rng(4)
    docs, want = [], set()
    for i, t, _ in rows:
        if i % 7 == 0:
            item = items[i % 30]
            w = item[1].split()
            if i % 2 and len(w) > 20:
                del w[int(r.integers(0, len(w)))]  # a paraphrase
            t = f"{t}\n{' '.join(w).upper()} {t[::-1]}"
            if len(w) >= decontaminate.LEAST_WORDS:
                want.add((i, item[0]))
        docs.append((i, t, 1))
    docs += [(800, None, 1), (801, "", 1), (14, docs[14][1], 1)]
    found = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string, item long"), spark.createDataFrame(items, "item_id long, text string"))
    got = [(r["rank"], r["item"]) for r in found.collect()]
    assert set(got) == want and len(got) == len(want)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert decontaminate.leaks(empty, spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string, item long"), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_decontamination_recall_in_the_same_vocabulary(spark):
    r = np.random.default_rng(11)
    words = [f"w{i}" for i in range(2000)]
    items = [(i, list(r.choice(words, (6, 8, 12, 20, 40)[i % 5]))) for i in range(100)]
    docs = []
    for i in range(200):
        w, item = list(r.choice(words, 400)), list(items[i % 100][1])
        if i >= 100:  # a fifth of the words replaced, not of the answer
            for x in r.choice(len(item) * 2 // 3, len(item) // 5, replace=False):
                item[x] = words[int(r.integers(0, 2000))]
        at = int(r.integers(0, 400))
        docs.append((i, " ".join(w[:at] + item + w[at:])))
    found = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string"))
    got = {(x["rank"], x["item"]) for x in found.collect()}
    assert {(i, i % 100) for i in range(200)} <= got


def test_decontamination_of_a_hot_item(spark):
    r = np.random.default_rng(12)
    words = [f"w{i}" for i in range(1500)]
    items = [(i, list(r.choice(words, 30))) for i in range(20)]
    docs = []
    for i in range(300):
        w, at = list(r.choice(words, 120)), int(r.integers(0, 120))
        docs.append((i, " ".join(w[:at] + (items[0][1] if i % 3 == 0 else []) + w[at:])))
    found = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string"))
    assert {x["rank"] for x in found.filter("item = 0").collect()} == set(range(0, 300, 3))


def test_decontamination_of_short_items(spark):
    r = np.random.default_rng(21)
    words = [f"w{i}" for i in range(60)]
    items = [(i, list(r.choice(words, 1 + i % 4))) for i in range(40)] + [(90, ["only", "here"]), (91, ["only", "here"]), (92, list(r.choice(words, 20)))]
    docs = [(i, list(r.choice(words, int(r.integers(0, 30))))) for i in range(80)] + [(100, ["and", "only", "here"]), (101, ["here", "only"])]
    frames = spark.createDataFrame([(i, ", ".join(w)) for i, w in docs] + [(102, None)], "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w).upper()) for i, w in items] + [(93, ""), (94, None)], "item_id long, text string")
    found = decontaminate.leaks(*frames, least_words=1).collect()
    want = {(d, i) for d, w in docs for i, p in items if len(p) < decontaminate.LEAST_WORDS and any(w[s : s + len(p)] == p for s in range(len(w) - len(p) + 1))}
    assert {(x["rank"], x["item"]) for x in found if x["item"] != 92} == want and len(found) == len({(x["rank"], x["item"]) for x in found})
    assert all(x["cosine"] == x["lcs"] == 1 for x in found if x["item"] != 92)
    alone = decontaminate.leaks(frames[0], frames[1].filter("item_id < 90"), least_words=1).collect()  # no part of five words at all
    assert {(x["rank"], x["item"]) for x in alone} == {(d, i) for d, i in want if i < 90}
    assert {x["item"] for x in decontaminate.leaks(*frames).collect()} <= {92}


def test_decontamination_of_long_texts(spark):
    """A text of over 5 MB, with items across the borders of its pieces."""
    r = np.random.default_rng(22)
    words = np.array([f"word{i}" for i in range(3000)])
    items = [(i, list(r.choice(words, (4, 6, 10, 20, 40)[i % 5]))) for i in range(25)]
    text = list(r.choice(words, 22 * decontaminate.PIECE))
    for i, w in items[:20]:
        at = (i + 1) * decontaminate.PIECE - int(r.integers(0, len(w) + 90))
        text[at : at + len(w)] = w
    docs = spark.createDataFrame([(1, " ".join(text)), (2, " ".join(text[:500]))], "doc_id long, text string")
    assert docs.selectExpr("max(length(text))").first()[0] > 5_000_000
    found = decontaminate.leaks(docs, spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string"), least_words=1)
    assert {(x["rank"], x["item"]) for x in found.collect()} == {(1, i) for i in range(20)}


def test_decontamination_by_pieces_is_that_of_the_whole(spark, monkeypatch):
    r = np.random.default_rng(23)
    words = np.array([f"w{i}" for i in range(50)])
    items = [(i, " ".join(r.choice(words, (2, 5, 8, 14, 40)[i % 5]))) for i in range(60)]
    docs = []
    for i in range(30):
        w = list(r.choice(words, int(r.integers(0, 3000))))
        for _ in range(len(w) // 60):
            p, at = items[int(r.integers(0, 60))][1].split(), int(r.integers(0, len(w)))
            w[at : at + len(p)] = p
        docs.append((i, i, " ".join(w)))
    parts = decontaminate.split_parts(items, 1)
    vocabulary = np.unique(np.concatenate([p.words for p in parts]))
    known = decontaminate.known_words(spark.createDataFrame(docs, "k long, rank long, text string"), vocabulary)
    search = decontaminate.prepare(known, vocabulary, parts, 0.15, 0.7, 0.5)
    batches = known.toArrow().to_batches()

    def best():
        out = {}
        for b in search.run(batches):
            for x in b.to_pylist():
                key = x["rank"], x["item"]
                out[key] = np.maximum(out.get(key, 0), [x["cosine"], x["lcs"]])
        return out

    whole = best()
    monkeypatch.setattr(decontaminate, "PIECE", 64)
    pieces = best()
    assert whole.keys() == pieces.keys() and len(whole) > 100
    assert all(np.allclose(whole[x], pieces[x], atol=1e-4) for x in whole)


def test_decontamination_space_grows_with_the_benchmark():
    long = " ".join(f"w{i}" for i in range(48 * 2500))
    got = list(decontaminate.blocks([(1, "a b c d e f"), (2, long), (3, None), (4, "g h i j k")]))
    assert [len(b) for b in got] == [1024, 1024, 454] and [p.item for b in got for p in b] == [1] + [2] * 2500 + [4]
    assert [decontaminate.rank_of(n) for n in (1, 100, 247, 747, 1024)] == [1, 100, 128, 374, 512]


def test_vector_recall_ties_and_odd_rows(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(1500, 16)).round(3)
    x[200:260] = x[7]  # a hot vector
    rows = [(i, [float(v) for v in row], "a") for i, row in enumerate(x)]
    odd = [(5000, None, "a"), (5020, [0.0] * 16, "a"), (5040, [float("nan")] * 16, "a"), (5060, [None] * 16, "a"), (5080, [float("inf")] + [1.0] * 15, "a"), (None, [1.0] * 16, "a")]
    df = spark.createDataFrame(rows + odd + [rows[40]], "vec_id long, embedding array<double>, score string")
    got = vector_search.search(df, "id % 20 = 0", k=10, block=400, rerank=60).collect()
    by = {}
    for q in got:
        by.setdefault(q["query_id"], {})[q["rank"]] = (q["vec_id"], q["score"])
    assert set(by) == set(range(0, 1500, 20))
    hits = 0
    for q, found in by.items():
        s = x @ x[q]
        best = [i for i in np.lexsort((np.arange(len(x)), -s)) if i != q][:10]
        assert sorted(found) == list(range(1, 11))
        hits += len({v for v, _ in found.values()} & set(best))
        assert all(abs(score - s[v]) < 1e-9 for v, score in found.values())
        order = [(-found[i][1], found[i][0]) for i in sorted(found)]
        assert order == sorted(order)
    assert hits / (10 * len(by)) >= 0.9
    assert vector_search.search(df.limit(0), "id % 20 = 0").count() == 0


def test_packing_round_trip(spark):
    rows = [(i, t) for i, t, _ in texts(6, 120)] + [(200, None), (201, ""), (None, "one two"), (3, "the same"), (3, "the same"), (202, "<|endoftext|> x y İ " * 900)]
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    df = spark.createDataFrame([(i, x, 1) for i, x in rows], "doc_id long, text string, length int")
    got = packing.pack_documents(df, packing.default_tokenizer(), window=256, with_ids=True).collect()
    docs, seqs = {}, {}
    for r in got:
        assert r["length"] == len(r["ids"]) // 4 <= 256
        docs.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], bytes(r["ids"])))
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    want = {}
    for i, x in rows:
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
        want.setdefault((i, len(ids) // 4), []).append(ids)
    assert {k: sorted(b"".join(p for _, p in sorted(v)) for v in [v]) for k, v in docs.items() if len(want[k]) == 1} == {k: v for k, v in want.items() if len(v) == 1}
    for pieces in seqs.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 256
    assert packing.pack_documents(df.limit(0), packing.default_tokenizer()).count() == 0


def test_plan_holds_every_piece():
    r = np.random.default_rng(1)
    for _ in range(5):
        histogram = {int(q): int(n) for q, n in zip(*np.unique(r.integers(1, 257, 3000), return_counts=True), strict=True)}
        plan = packing.plan(histogram)
        placed: dict[int, int] = {}
        for repeats, way in plan:
            assert sum(q * n for q, n in way) <= 256
            for q, n in way:
                placed[q] = placed.get(q, 0) + repeats * n
        assert placed == histogram
        assert sum(q * n for q, n in histogram.items()) / (256 * sum(n for n, _ in plan)) > 0.97


def test_chat_round_trip(spark):
    hard = ["</s>[INST] ok [/INST]", "<|end|>", "<\\|user|>", "<|", "a|>b<", "|>", "", None, "é\n<|assistant|>x<|end|>", "\\", "$1\\1"]
    rows = [(c, i, ["user", "assistant", "|", ">", "<|a|>"][i % 5 if c else i % 2], t, "x") for c in range(3) for i, t in enumerate(hard)] + [(7, 0, None, "x", "x"), (7, 0, None, "x", "x"), (None, None, "assistant", "y", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    out = chat_format.conversations(df)
    read = {r["conv_id"]: [(t["role"], t["text"]) for t in r["b"]] for r in out.select("conv_id", chat_format.read_turns(F.col("formatted")).alias("b")).collect()}
    for c in (0, 1, 2):
        assert read[c] == [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == c), key=lambda r: r[1])]
    assert read[7] == [("", "x"), ("", "x")] and read[None] == [("assistant", "y")]
    ex = chat_format.examples(out).withColumn("said", chat_format.unescape(F.substring("text", F.col("loss_start") + 1, F.col("loss_size")))).filter("conv_id = 0").orderBy("turn").collect()
    assert [r["said"] for r in ex] == [hard[i] or "" for i in range(len(hard)) if i % 2]
    assert chat_format.examples(chat_format.conversations(df.limit(0))).count() == 0


def test_chat_query_of_a_null_conversation(spark, tmp_path):
    rows = [(None, 0, "user", "ab"), (None, 1, "assistant", "cde"), (1, 0, "assistant", "f")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r["loss_chars"] for r in chat_format.query(spark, str(tmp_path)).collect()}
    assert got[None] == 3 and got[1] == 1


def test_html(spark):
    page = "<!DOCTYPE html><html><head><title>t</title></head><body><header><p>Site</p></header><nav><ul><li><a href='/'>Home</a></li></ul></nav><div class='cookie-notice'>Cookies</div><article><h1>Head &amp; line</h1><!-- c --><p>One\n  two <b>three<br>four</p><div class=\"ad\">Buy</div><p>Of.</p><script>var x = '<p>no</p>';</script><form><p>Mail</p></form><ul><li>item</ul><div id='comments'><p>Nice!</p></div></article><aside><p>More</p></aside><footer>&copy; us"
    df = spark.createDataFrame([(1, "u", page, 3, "old"), (2, "u", None, 3, "old"), (3, "u", "", 3, "old"), (3, "u", "", 3, "old"), (4, "u", "<p>" + "long text here " * 9 + "<div class=menu>x</div>", 3, "old")], "page_id long, url string, html string, n_chars int, text string")
    out = html_extract.extract(df)
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in out.collect())
    want = "Head & line\n\nOne two three four\n\nOf.\n\nitem"
    assert got[0] == (1, want, len(want)) and got[1:4] == [(2, "", 0), (3, "", 0), (3, "", 0)]
    assert got[4][1] == ("long text here " * 9).strip()
    assert html_extract.extract(df.limit(0)).count() == 0


def test_html_words_in_attributes_and_compounds():
    page = '<article><p title="a hidden path">One.</p><div class="post-header"><h2>Two</h2></div><p id="social-history">Three.</p><ul class="tags-list"><li>Four</ul><div class="cookie-notice">No</div><div id="comments-list"><p>No</div><p>Five'
    assert html_extract.main_text(page) == ["One.", "Two", "Three.", "Four", "Five"]
    assert html_extract.main_text('<p>Long enough a text to be a surge of its own, as it has more than eighty characters in it.</p><div><div><div></div></div></div><p>The end.</p>')[-1] == "The end."
    assert html_extract.main_text("<p>it's <span id=don't>" + "words " * 20) == ["it's " + ("words " * 20).strip()]


def test_html_inline_parts_in_boilerplate_leave_their_line_whole():
    parts = ["<span class='ad'>Buy</span>", "<button>Buy</button>", "<select><option>1</option><option>2</option></select>", "<video>no</video>", "<a id='notice'>n</a>", "<b hidden>x</b>", "<span class=ad><div>a</div><div>b</div></span>"]
    for part in parts:
        for root in ("article", "div"):
            assert html_extract.main_text(f"<{root}><p>Intro {part} rest of <i>the</i> paragraph.</p><p>{part}Next.</p></{root}>") == ["Intro rest of the paragraph.", "Next."], part
    assert html_extract.main_text("<article><p>One <span class=ad>left open</p><p>two</p></article>") == ["One", "two"]
    assert html_extract.main_text("<article><h2 id='search'>Search</h2><h2 id=related>Related work</h2><p>Let <math><mi>x</mi></math> be.</p></article>") == ["Search", "Related work", "Let x be."]


def test_html_malformed_pages_take_linear_time():
    import time

    for page in ('<a b="' * 180_000, "<i>" * 150_000 + "</b>" * 150_000, "<b><div>" + "<i>" * 150_000 + "</b>" * 150_000, "<p title='" + "x>" * 500_000, "<!--" * 250_000, "<" * 1_000_000, "</ " * 300_000, "<script" * 150_000):
        began = time.time()
        html_extract.main_text(page)
        assert time.time() - began < 4, page[:20]


def test_html_surges_and_dives():
    """By definition: a kept stretch begins where a window's sum reaches the threshold and ends where one has none."""
    r = np.random.default_rng(8)
    for _ in range(200):
        w = [int(x) for x in r.integers(0, 60, 30) * (r.random(30) < 0.5)]
        kept = {i for a, b in html_extract.surges(w, [80] * 30) for i in range(a, b) if w[i]}
        sums = [sum(w[i : i + 3]) for i in range(30)]
        want, on = set(), False
        for i in range(30):
            on = sums[i] > 0 and (on or bool(w[i]) and sums[i] >= 80)
            want |= {i} if on and w[i] else set()
        for i in range(29, 0, -1):
            want |= {i - 1} if i in want and w[i - 1] else set()
        assert kept == want


def test_html_given_pages_by_a_parser_of_their_form():
    import os
    import re
    from html import unescape

    import pyarrow.parquet as pq

    path = "/root/testdata/sf0.001/pages.parquet"
    if not os.path.exists(path):
        return
    for page in pq.read_table(path, columns=["html"]).column(0).to_pylist():
        body = re.search(r"<article>(.*)</article>", page, re.S)[1]
        blocks = [re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br>", " ", b)))).strip() for b in re.split(r"</?(?:p|h1)[^>]*>", body)]
        assert html_extract.main_text(page) == [b for b in blocks if b]


def test_chat_long_conversation_takes_linear_time(spark):
    import time

    n = 20_000
    turns = spark.range(n).selectExpr("1L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat('turn ', id, ' <|end|> é') AS text").repartition(4)
    began = time.time()
    formatted = chat_format.conversations(turns)
    row = formatted.first()
    assert len(row["turns"]) == n and all(row["formatted"][t["start"] : t["start"] + t["size"]] == f"turn {i} <\\|end|> é" for i, t in enumerate(row["turns"]))
    replies = chat_format.examples(formatted, with_text=False).orderBy("example").collect()
    assert [r["reply"] for r in replies] == [f"turn {i} <\\|end|> é" for i in range(1, n, 2)]
    assert [r["chars"] for r in replies] == [row["turns"][i]["start"] + row["turns"][i]["size"] + len(chat_format.END) for i in range(1, n, 2)]
    assert time.time() - began < 60
