"""Each stage against a plain version, then the whole on odd tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from buildtrail.llm import decontaminate, packing

from . import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k string, rank int, score int, root string, n_removed string"


def is_toxic(text):
    return sum(w in ("idiot", "scum", "trash") for w in (text or "").split()) >= 3


def corpus(seed=2, n=80):
    r = np.random.default_rng(seed)
    words = [f"{a}{b}" for a in "bdfgklmnprst" for b in ("ale", "ion", "ura", "est", "omi", "ack")]
    say = lambda k: " ".join(r.choice(words, k))
    toxic = ["idiot", "scum", "trash"]
    items = [(i, say(20 + i)) for i in range(6)]
    rows, labels = [], []
    line = say(12)
    for i in range(n):
        text = "\n".join([say(int(r.integers(8, 30))) for _ in range(int(r.integers(1, 4)))] + ([line] if i % 3 == 0 else []))
        if i % 6 == 1:
            text += " " + " ".join(r.choice(toxic, 5))
        if i % 11 == 5:
            text += "\n" + items[i % 6][1]
        if i % 7 == 3 and rows:
            text = (rows[i - 2][1] or "") + " " + say(1)
        rows.append((i, text))
        labels.append((i, 1, int(is_toxic(text))))
    rows += [(200, None), (201, ""), (None, say(30)), rows[4], (202, rows[4][1])]
    return rows, labels, items


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "web", len(t or ""), "k", 3, 4, "r", "n") for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    rows, labels, items = corpus()
    frame(spark, rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def pairs(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)


def test_toxic_documents_go_and_clean_ones_stay(spark, folder):
    rows, _, _ = corpus()
    out = corpus_pipeline.drop_toxic(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    assert out.columns == spark.read.parquet(f"{folder}/documents.parquet").columns
    assert pairs(out) == sorted((x for x in rows if not is_toxic(x[1])), key=repr)


def test_lines(spark, folder):
    rows, _, _ = corpus()
    out = corpus_pipeline.drop_lines(spark, frame(spark, rows), folder)
    kept = {(i, t): k for (i, t), (_, k) in zip(sorted({r for r in rows if r[1] is not None}, key=lambda r: (brute.last(r[0]), r[1])), brute.kept_lines(rows, 16), strict=True)}
    want = [(i, t if t is None else kept[i, t]) for i, t in rows if t is None or kept[i, t] == t or kept[i, t].strip(" ")]
    assert pairs(out) == sorted(want, key=repr)
    assert all(r["n_chars"] == len(r["text"] or "") and r["n_removed"] == "n" for r in out.collect())


def test_one_of_each_class_stays(spark, folder):
    rows, _, _ = corpus()
    out = corpus_pipeline.drop_near_copies(spark, frame(spark, rows), folder)
    classes = brute.jaccard_classes(rows)
    want = {}
    for (i, t), (_, n, root) in zip(rows, classes, strict=True):
        if not n or brute.last(i) == root:
            want.setdefault((i, t), (i, t))
    assert pairs(out) == sorted(want.values(), key=repr)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_leaks_go(spark, folder):
    """By brute force: a document leaks if a stretch of an item's length holds most of the item and of its last third."""
    rows, _, items = corpus()

    def leaks(text):
        w = (text or "").split()
        for _, t in items:
            p = t.split()
            for s in range(max(1, len(w) - len(p) + 1)):
                near = w[s : s + len(p)]
                if lcs(p, near) >= 0.9 * len(p) and lcs(p[-(len(p) // 3) :], near) >= 0.5 * (len(p) // 3):
                    return True
        return False

    out = corpus_pipeline.drop_leaks(spark, frame(spark, rows), folder)
    assert pairs(out) == sorted((x for x in rows if not leaks(x[1])), key=repr)
    assert decontaminate.LEAST_WORDS == 5


def test_packing_holds_all_that_is_left(spark, folder):
    from tokenizers import Tokenizer

    rows, _, _ = corpus()
    t = Tokenizer.from_file(packing.default_tokenizer())
    out = corpus_pipeline.pack(spark, frame(spark, rows), folder).collect()
    assert sum(r["length"] for r in out) == sum(len(t.encode(x or "", add_special_tokens=False).ids) + 1 for _, x in rows)


def test_run_applies_all_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), docs.schema)
    want = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    cols = ["doc_id", "doc_tokens", "ids_crc32"]
    whole = lambda df: sorted(map(tuple, df.filter("length = doc_tokens").select(*cols).collect()), key=repr)
    got = corpus_pipeline.run(spark, folder)
    assert got.agg(F.sum("length")).first() == want.agg(F.sum("length")).first()
    assert got.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert whole(got)


def test_empty_tables(spark, folder, tmp_path):
    path = str(tmp_path)
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{path}/{name}.parquet")
    assert corpus_pipeline.run(spark, path).count() == 0
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.drop("n_chars"), path).columns == docs.drop("n_chars").columns
