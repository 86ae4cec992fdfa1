"""Golden cases of covers, links and trees, many trees in one call."""

import pytest

from buildtrail.operators import covers, store

ENTRIES = "tree string, path string, kind string, mode int, content_key string, target string"


def entries(spark, trees):
    """{tree: {path: content, or "->target" of a link}}"""
    rows = []
    for tree, files in trees.items():
        for path, v in files.items():
            link = v.startswith("->")
            rows.append((tree, path, "link" if link else "file", 0o644, None if link else v, v[2:] if link else None))
    return spark.createDataFrame(rows, ENTRIES)


def builds(spark, rows):
    return spark.createDataFrame(rows, "build string, tree string, dir string, complete boolean")


def paths(spark, rows, first="build"):
    return spark.createDataFrame(rows, f"{first} string, path string")


TREES = {
    "seeds": {"services/api/BUILD": "r", "lib/common/go.mod": "m", "docs/readme.md": "d", "extra/other": "o"},
    "chain": {"sibling/file.txt": "t", "covered/link.txt": "->../sibling/file.txt", "covered/own": "o", "c.txt": "e", "b.txt": "->c.txt", "a.txt": "->b.txt"},
    "through": {"real/inner.txt": "i", "linkdir": "->real"},
    "cycle": {"a": "->b", "b": "->a"},
    "dangling": {"link": "->missing.txt"},
    "escaping": {"abs": "->/etc/hosts", "up": "->../outside.txt", "d/x": "->.."},
    "deep": {"shared/data.txt": "d", "app/sub/deep/f.go": "c", "app/sub/deep/link": "->../../../shared/data.txt"},
    "closure": {"lib/common/a.txt": "a", "services/api/go.mod": "m", "docs/x.txt": "x"},
    "long": {**{f"l{i}": f"->l{i + 1}" for i in range(60)}, "l60/f": "f"},
}


def test_covered_paths(spark):
    cases = {  # build: (tree, dir, complete, declared, allowed, wanted)
        "seeds": ("seeds", "services/api", False, ["lib/common", "docs/readme.md"], [], {"docs/readme.md", "lib/common", "services/api"}),
        "chain": ("chain", "covered", False, ["a.txt"], [], {"a.txt", "b.txt", "c.txt", "covered", "sibling/file.txt"}),
        "through": ("through", "", False, ["linkdir/inner.txt"], [], {"linkdir", "linkdir/inner.txt", "real/inner.txt"}),
        "cycle": ("cycle", "", False, ["a"], [], {"a", "b"}),
        "loop": ("cycle", "", False, ["a/x"], [], {("a/x", "loop")}),
        "dangling": ("dangling", "", False, ["link"], [], {"link", ("missing.txt", "dangling")}),
        "seed too": ("dangling", "", False, ["link", "missing.txt"], [], {("missing.txt", "missing")}),
        "absolute": ("escaping", "", False, ["abs"], [], {("abs", "absolute")}),
        "escapes": ("escaping", "", False, ["up"], [], {("up", "escapes")}),
        "allowed": ("escaping", "", False, ["up", "abs"], ["up", "abs"], {"up", "abs"}),
        "never on the way": ("escaping", "", False, ["abs/x"], ["abs"], {("abs/x", "absolute")}),
        "to the root": ("escaping", "", False, ["d"], [], {("", "root")}),
        "missing": ("seeds", "", False, ["no/such/path"], [], {("no/such/path", "missing")}),
        "below a file": ("seeds", "", False, ["docs/readme.md/x"], [], {("docs/readme.md/x", "through_file")}),
        "nothing": ("seeds", "", False, [], [], {("", "empty")}),
        "deep": ("deep", "app", False, [], [], {"app", "shared/data.txt"}),
        "complete": ("closure", "", True, ["lib/common"], [], {"lib/common"}),
        "own file": ("closure", "services/api", True, ["lib/common", "services/api/go.mod"], [], {"lib/common", "services/api/go.mod"}),
        "not over dir": ("closure", "services/api", True, ["lib/common"], [], {("services/api", "dir")}),
        "above dir": ("closure", "services/api", True, ["services"], [], {"services"}),
        "complete, empty": ("closure", "", True, [], [], {("", "empty")}),
        "complete, missing": ("closure", "", True, ["nope"], [], {("nope", "missing")}),
    }
    got = covers.covered_paths(
        builds(spark, [(b, c[0], c[1], c[2]) for b, c in cases.items()]),
        paths(spark, [(b, p) for b, c in cases.items() for p in [*c[3], None]]),
        entries(spark, TREES),
        paths(spark, [(b, p) for b, c in cases.items() for p in c[4]]),
    ).collect()
    found = {b: set() for b in cases}
    for r in got:
        assert (r["outcome"] == "covered") == (r["reason"] is None)
        found[r["build"]].add(r["path"] if r["reason"] is None else (r["path"], r["reason"]))
    assert found == {b: c[5] for b, c in cases.items()}


def test_resolve_links_budget(spark):
    asked = [("long", f"l{i}/f") for i in range(60)] + [("cycle", "a/x"), ("cycle", "a"), ("through", "linkdir//./inner.txt"), ("through", "/"), ("gone", "x"), ("long", None)]
    got = {(r["tree"], r["path"]): r for r in covers.resolve_links(paths(spark, asked, "tree"), entries(spark, TREES)).collect()}
    assert len(got) == 65
    for i in range(60):
        r = got["long", f"l{i}/f"]
        n = 60 - i
        assert r["links"] == [f"l{k}" for k in range(i, min(60, i + covers.LINK_BUDGET))]
        assert (r["state"], r["resolved"]) == (("found", "l60/f") if n <= covers.LINK_BUDGET else ("loop", None))
    assert got["cycle", "a/x"]["state"] == "loop" and got["cycle", "a/x"]["links"] == ["a", "b"] * 20
    assert (got["cycle", "a"]["state"], got["cycle", "a"]["kind"], got["cycle", "a"]["target"]) == ("found", "link", "b")
    assert got["through", "linkdir//./inner.txt"]["resolved"] == "real/inner.txt"
    assert got["through", "/"]["state"] == "root" and got["gone", "x"]["state"] == "missing"


def test_few_and_many_links_agree(spark, monkeypatch):
    asked = paths(spark, [("long", f"l{i}/f") for i in range(0, 60, 7)], "tree")
    few = sorted(covers.resolve_links(asked, entries(spark, TREES)).collect())
    monkeypatch.setattr(covers, "FEW_LINKS", 0)
    assert sorted(covers.resolve_links(asked, entries(spark, TREES)).collect()) == few


def test_prune(spark):
    e = entries(spark, {"t": {"a/b/f": "1", "a/b/g": "2", "a/c": "3", "d/e": "4", "l": "->a"}})
    keep = spark.createDataFrame([("x", "t", "a/b"), ("x", "t", "/a/b/f/"), ("x", "t", "l"), ("y", "t", "a/c/z"), ("y", "t", "no"), ("y", "t", "l/b"), ("z", "t", "."), ("v", "t", "a"), ("v", "t", "a/missing")], "build string, tree string, path string")
    got = {}
    for r in covers.prune_trees(e, keep).collect():
        got.setdefault(r["build"], {})[r["path"]] = r["kind"]
    assert got["x"] == {"a": "dir", "a/b": "dir", "a/b/f": "file", "a/b/g": "file", "l": "link"}
    assert got["v"] == {"a": "dir", "a/b": "dir", "a/b/f": "file", "a/b/g": "file", "a/c": "file"}
    b = spark.createDataFrame([(x, "t") for x in "xyzvw"], "build string, tree string")
    assert {tuple(r) for r in covers.prune_errors(b, e, keep).collect()} == {("y", "a/c/z", "through_file"), ("y", "l/b", "through_file"), ("y", "no", "missing"), ("z", ".", "root"), ("w", "", "empty")}


def test_overlay(spark):
    e = entries(spark, {"t": {"a/f": "1", "d/g": "2", "l": "->a"}}).withColumnRenamed("tree", "build")
    files = lambda *p: spark.createDataFrame([("t", x, f"new {x}") for x in p], "build string, path string, content_key string")
    got = {r["path"]: (r["kind"], r["mode"], r["origin"]) for r in covers.overlay_trees(e, files("a/f", "x/y/z", "l")).collect()}
    assert got == {"a/f": ("file", 0o444, "replaced"), "x": ("dir", 0o555, "made"), "x/y": ("dir", 0o555, "made"), "x/y/z": ("file", 0o444, "added"), "l": ("file", 0o444, "replaced"), "d/g": ("file", 0o644, "kept")}
    wrong = {tuple(r)[1:] for r in covers.overlay_errors(e, files("p/q", "p/q/r", "a", "d/g/h", "l/x", "..", "/m", "m")).collect()}
    assert wrong == {("p/q/r", "below_file"), ("a", "directory"), ("d/g/h", "through_file"), ("l/x", "through_file"), ("", "root"), ("m", "conflict")}
    assert covers.overlay_errors(e, files("a/f", "x/y/z", "l")).count() == 0


BASE = {"services/api/BUILD": "recipe", "services/api/main.go": "main", "lib/common/common.go": "common", "docs/readme.md": "docs"}


def test_identity_moves_with_the_cover_alone(spark):
    trees = {"base": BASE, "outside": {**BASE, "docs/readme.md": "docs v2", "docs/new.md": "new"}, "inside": {**BASE, "lib/common/common.go": "v2"}}
    rows, declared, files = [], [], []

    def build(name, tree, sources=("lib/common",), dir="services/api", complete=False, platform="p", pinned="b", generated=None):
        rows.append((name, tree, dir, complete, platform, pinned))
        declared.extend((name, s) for s in sources)
        files.extend((name, p, c) for p, c in (generated or {}).items())

    for tree in trees:
        build(tree, tree)
        build(f"whole {tree}", tree, (), "")
    build("platform", "base", platform="q")
    build("pinned", "base", pinned="c")
    build("lock a", "base", generated={"services/api/lock": "a"})
    build("lock a again", "base", generated={"services/api/lock": "a"})
    build("lock b", "base", generated={"services/api/lock": "b"})
    build("capped", "base", generated={"a.bin": "x" * covers.GENERATED_CAP, "b.bin": "y"})
    build("on a directory", "base", generated={"services/api": "x"})
    build("missing", "base", ("nope",))
    build("by sources", "base", ("lib/common",), "")
    build("by closure", "base", ("lib/common",), "", True)
    b = spark.createDataFrame(rows, "build string, tree string, dir string, complete boolean, platform string, pinned string")
    f = spark.createDataFrame(files, "build string, path string, content string")
    got = {r["build"]: r for r in covers.cover_identity(b, paths(spark, declared), entries(spark, trees), paths(spark, []), f).collect()}
    key = {k: r["identity"] for k, r in got.items()}
    assert len(got) == len(rows)
    assert key["base"] == key["outside"] != key["inside"] and key["base"]
    assert len({key[f"whole {t}"] for t in trees}) == 3
    assert key["lock a"] == key["lock a again"] and len({key[k] for k in ("base", "lock a", "lock b", "platform", "pinned")}) == 5
    assert key["by sources"] == key["by closure"] not in (None, key["base"])
    problems = {k: r["problem"] for k, r in got.items() if r["problem"]}
    assert problems == {"capped": "generated: oversized", "on a directory": "overlay: directory services/api", "missing": "cover: missing nope"} and all(key[k] is None for k in problems)


@pytest.mark.parametrize("normalize", [True, False])
def test_merkle_metadata(spark, normalize):
    schema = f"{ENTRIES}, uid int, gid int, mtime long"
    rows = [("a", "d/f", "file", 0o644, "1", None, 7, 7, 5), ("b", "d/f", "file", 0o644, "1", None, 0, 0, 9), ("c", "d/f", "file", 0o755, "1", None, 7, 7, 5), ("d", "d/f", "link", 0o644, None, "1", 7, 7, 5), ("a", "e", "dir", 0o700, None, None, 1, 1, 1)]
    rows += [(t, "e", "dir", 0o700, None, None, 1, 1, 1) for t in "bcd"]
    got = {r["tree"]: r["digest"] for r in store.merkle_trees(spark.createDataFrame(rows, schema), normalize).filter("path = ''").collect()}
    assert (got["a"] == got["b"]) == normalize and len(set(got.values())) == (3 if normalize else 4)
