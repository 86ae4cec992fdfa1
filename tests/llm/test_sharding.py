import collections
import hashlib
import zlib

from buildtrail.llm import sharding

from .test_dedup import corpus

SCHEMA = "doc_id long, text string, source string, key string, shard int, stratum int, n int"


def rows(seed=3):
    texts = corpus(seed, 150)
    many = [(None, None, None)] * 30 + [(7, "again", "hot")] * 25
    return [(i, t, ["hot", "hot", "hot", "b", None, f"own-{k}"][k % 6]) for k, (i, t) in enumerate(texts)] + many


def plain(data, shards, seed=sharding.SEED):
    """{(id, crc): [(shard, slot)]} by sorting everything."""
    digest = lambda s: hashlib.md5(f"{seed}:{s}".encode()).hexdigest()
    groups = collections.defaultdict(list)
    for i, t, s in data:
        groups[digest("null" if s is None else f"={s}")].append((digest(f"{'' if i is None else i}:{t or ''}"), i, t or ""))
    order = []
    for stratum, members in groups.items():
        phase = (int(stratum[:7], 16) + 0.5) / 2.0**28
        order += [((r + phase) / len(members), stratum, r, i, t) for r, (_, i, t) in enumerate(sorted(members, key=lambda m: m[0]))]
    out, held = [], collections.Counter()
    for place, (_, _, _, i, t) in enumerate(sorted(order, key=lambda o: o[:3])):
        shard = place * shards // len(order)
        out.append((i, len(t.encode()) + 8, zlib.crc32(t.encode()), shard, held[shard]))
        held[shard] += 1
    return out


def frame(spark, data):
    return spark.createDataFrame([(i, t, s, "k", 1, 2, 3) for i, t, s in data], SCHEMA).repartition(3)


def dealt(df):
    return sorted((tuple(r) for r in df.select("doc_id", "size", "text_crc32", "shard", "slot").collect()), key=repr)


def test_equals_plain_order(spark, monkeypatch):
    data = rows()
    for rows_a_cell, copies in ((20_000, 10_000), (5, 4)):
        monkeypatch.setattr(sharding, "ROWS", rows_a_cell)
        monkeypatch.setattr(sharding, "COPIES", copies)
        assert dealt(sharding.assign(frame(spark, data), 24)) == sorted(plain(data, 24), key=repr)


def test_every_shard_holds_the_mixture(spark):
    data = [(k, f"text {k}", ["a"] * 60 + ["b"] * 30 + ["c"] * 9 + ["d"]) for k in range(4000)]
    data = [(k, t, s[k % 100]) for k, t, s in data]
    found = sharding.assign(frame(spark, data), 10).collect()
    source = {k: s for k, _, s in data}
    by = collections.Counter((r["shard"], source[r["doc_id"]]) for r in found)
    assert {n for _, n in collections.Counter(r["shard"] for r in found).items()} == {400}
    for shard in range(10):
        for s, want in (("a", 240), ("b", 120), ("c", 36), ("d", 4)):
            assert abs(by[shard, s] - want) <= 4


def test_fewer_rows_than_shards_and_none(spark):
    few = sharding.assign(frame(spark, [(1, "x", "a"), (2, None, None)]), 24).collect()
    assert len({r["shard"] for r in few}) == 2 and all(r["slot"] == 0 for r in few)
    assert sharding.assign(frame(spark, [(1, "x", "a")]).limit(0), 24).count() == 0
    assert sharding.assign(frame(spark, [(1, "x", "a"), (2, "y", "b")]), 1, source_col=None).count() == 2


def test_written_shards_hold_the_texts(spark, tmp_path):
    data = rows(5)
    sharding.write_shards(frame(spark, data), f"{tmp_path}/out", 6, rows_a_file=20)
    back = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted(((r["doc_id"], r["text"], r["source"]) for r in back), key=repr) == sorted(data, key=repr)
    slots = collections.defaultdict(list)
    for r in back:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    found = con.execute(sharding.SQL)
    names = [d[0] for d in found.description]
    want = sorted((tuple(dict(zip(names, r, strict=True))[c] for c in ("doc_id", "size", "text_crc32", "shard", "slot")) for r in found.fetchall()), key=repr)
    assert dealt(sharding.query(spark, "/root/testdata/sf0.001")) == want
