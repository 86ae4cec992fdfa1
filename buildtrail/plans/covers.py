"""Queries of covers and trees over the driver's tables: source trees of sixty pages each, with links of all kinds among them."""

from __future__ import annotations

from pyspark.sql import functions as F

from buildtrail.operators import covers, store


def pages(s, d):
    """A page with the host and leaf of the page after it; pages of sixty ids make a tree."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "^https?://", ""), r"[?#].*$", ""), "/+$", "")
    p = s.read.parquet(f"{d}/pages.parquet").select(F.col("page_id").alias("k"), F.floor(F.col("page_id") / 60).alias("tree"), F.substring_index(bare, "/", 1).alias("host"), F.substring_index(bare, "/", -1).alias("leaf"), F.sha2("html", 256).alias("content_key"))
    after = p.select((F.col("k") - 1).alias("k"), F.col("host").alias("host2"), F.col("leaf").alias("leaf2"))
    return p.join(after, "k", "left").withColumn("path", F.concat("host", F.lit("/"), "leaf"))


def entries(s, d, chain=60):
    """Files, links of each kind, and chains of so many links that end in a directory."""
    p = pages(s, d)
    kind = F.col("k") % 25
    target = F.when(kind == 0, "/etc/x").when(kind == 5, "../../out").when(kind == 10, F.concat(F.lit("../"), "host2")).when(kind == 15, F.concat_ws("/", F.lit(".."), "host2", "leaf2")).when(kind == 20, F.col("leaf"))
    own = p.select("tree", "path", "k", F.when(target.isNull(), "file").otherwise("link").alias("kind"), F.when(F.col("k") % 4 == 0, 0o755).otherwise(0o644).alias("mode"), F.when(target.isNull(), F.col("content_key")).alias("content_key"), target.alias("target"))
    first = own.groupBy("tree", "path").agg(F.min_by(F.struct("kind", "mode", "content_key", "target"), "k").alias("r")).select("tree", "path", "r.*")
    next_one = F.when((F.col("k") % chain == chain - 1) | F.col("host2").isNull(), F.concat(F.lit("../"), "host")).otherwise((F.col("k") + 1).cast("string"))
    chained = p.select("tree", F.concat(F.lit("go/"), "k").alias("path"), F.lit("link").alias("kind"), F.lit(0o777).alias("mode"), F.lit(None).cast("string").alias("content_key"), next_one.alias("target"))
    return first.unionByName(chained)


def asked(s, d):
    p = pages(s, d)
    paths = F.array("path", F.concat(F.lit("go/"), "k", F.lit("/"), "leaf"), F.concat("path", F.lit("/x")), F.concat_ws("/", "path", F.coalesce("leaf2", F.lit("none"))))
    return p.select("tree", F.explode(paths).alias("path")).distinct()


def builds(s, d):
    return pages(s, d).filter("k % 6 = 0").select(F.col("k").alias("build"), "tree", F.when(F.col("k") % 12 == 0, "").otherwise(F.col("host")).alias("dir"), (F.col("k") % 18 == 12).alias("complete"), F.concat(F.lit("arch-"), F.col("k") % 5).alias("platform"), F.col("content_key").alias("pinned"))


def declared(s, d):
    p = pages(s, d).filter("k % 6 = 0 and k % 12 <> 0 and host2 is not null")
    paths = F.array(F.concat(F.lit("go/"), F.col("k") + 1), F.concat_ws("/", "host2", "leaf2"), F.when(F.col("k") % 42 == 6, F.concat(F.lit("nope/"), "k")))
    return p.select(F.col("k").alias("build"), F.explode(paths).alias("path")).filter("path is not null")


def allowed(s, d):
    free = pages(s, d).filter("k % 25 in (0, 5)").select("tree", "path").distinct()
    return builds(s, d).filter("build % 30 <> 6").select("build", "tree").join(free, "tree").select("build", "path")


def generated(s, d):
    """A file for each build: a new one, one in place of a file, one below a file, one in place of a directory, one that is the root."""
    b = pages(s, d).filter("k % 6 = 0").select(F.col("k").alias("build"), "host", "path", "content_key")
    path = F.when(F.col("build") % 7 < 3, F.concat("host", F.lit("/gen/new"))).when(F.col("build") % 7 == 3, F.col("path")).when(F.col("build") % 7 == 4, F.concat("path", F.lit("/sub"))).when(F.col("build") % 7 == 5, F.col("host")).otherwise("/")
    return b.select("build", path.alias("path"), F.col("content_key").alias("content"))


def keeps(s, d):
    """Paths to keep: some of trees' hosts, some files, some below files, some that aren't there."""
    p = pages(s, d).filter("k % 6 = 0")
    paths = F.array(F.when(F.col("k") % 18 == 6, F.col("host")), F.when(F.col("k") % 4 == 0, F.col("path")), F.when(F.col("k") % 8 == 2, F.concat("path", F.lit("/x"))), F.when(F.col("k") % 10 == 4, F.concat(F.lit("no/"), "k")), F.when(F.col("k") % 30 == 0, F.lit("/..")), F.concat(F.lit("go/"), "k"))
    return p.filter("k % 14 <> 0").select(F.col("k").alias("build"), "tree", F.explode(paths).alias("path")).filter("path is not null")


def whole(s, d):
    """Each build of ``builds`` with all entries of its tree."""
    return builds(s, d).select("build", "tree").join(covers.with_directories(entries(s, d)), "tree").drop("tree")


def overlaid(s, d):
    files = generated(s, d).select("build", "path", F.sha2("content", 256).alias("content_key"))
    return covers.overlay_trees(whole(s, d), files), covers.overlay_errors(whole(s, d), files)


QUERIES = {
    "resolve_links": lambda s, d: covers.resolve_links(asked(s, d), entries(s, d)).select("tree", "path", "resolved", "kind", "target", F.array_join("links", " ").alias("links"), "state"),
    "covered_paths": lambda s, d: covers.covered_paths(builds(s, d), declared(s, d), entries(s, d, 6), allowed(s, d)),
    "prune_trees": lambda s, d: covers.prune_trees(entries(s, d), keeps(s, d)),
    "prune_errors": lambda s, d: covers.prune_errors(builds(s, d), entries(s, d), keeps(s, d)),
    "overlay_trees": lambda s, d: overlaid(s, d)[0],
    "overlay_errors": lambda s, d: overlaid(s, d)[1],
    "merkle_trees": lambda s, d: store.merkle_trees(entries(s, d)),
    "cover_identity": lambda s, d: covers.cover_identity(builds(s, d), declared(s, d), entries(s, d, 6), allowed(s, d), generated(s, d)),
}

UP = lambda p, low=1, high=0: f"list_transform(range({low}, len(string_split({p}, '/')) + {high}), lambda i: array_to_string(string_split({p}, '/')[1:i], '/'))"  # noqa: E731  the directories above p; with high=1 p too

def trees_sql(chain: int = 60) -> str:
    """CTEs of ``pages`` and ``entries``, with all directories and where links point to."""
    return f"""
pg AS (
  SELECT k, k // 60 AS tree, split_part(bare, '/', 1) AS host, string_split(bare, '/')[-1] AS leaf, content_key
  FROM (SELECT page_id AS k, regexp_replace(regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', ''), '/+$', '') AS bare, sha256(html) AS content_key FROM pages)
), p AS MATERIALIZED (
  SELECT a.*, b.host AS host2, b.leaf AS leaf2, a.host || '/' || a.leaf AS path FROM pg a LEFT JOIN pg b ON b.k = a.k + 1
), own AS (
  SELECT tree, path, k, CASE k % 25 WHEN 0 THEN '/etc/x' WHEN 5 THEN '../../out' WHEN 10 THEN coalesce('../' || host2, '../') WHEN 15 THEN coalesce('../' || host2 || '/' || leaf2, '..') WHEN 20 THEN leaf END AS target,
    CASE WHEN k % 4 = 0 THEN 493 ELSE 420 END AS mode, content_key FROM p
), en AS MATERIALIZED (
  SELECT tree, path, CASE WHEN target IS NULL THEN 'file' ELSE 'link' END AS kind, mode, CASE WHEN target IS NULL THEN content_key END AS content_key, target
  FROM own QUALIFY row_number() OVER (PARTITION BY tree, path ORDER BY k) = 1
  UNION ALL SELECT tree, 'go/' || k, 'link', 511, NULL, CASE WHEN k % {chain} = {chain - 1} OR host2 IS NULL THEN '../' || host ELSE CAST(k + 1 AS VARCHAR) END FROM p
), fu AS MATERIALIZED (
  SELECT * FROM en UNION ALL SELECT tree, path, 'dir', 365, NULL, NULL FROM (SELECT DISTINCT tree, unnest({UP('path')}) AS path FROM en)
), lk AS MATERIALIZED (
  SELECT tree, path AS link, target, goal, CASE WHEN goal IS NULL THEN 'absolute' WHEN goal = '..' OR starts_with(goal, '../') THEN 'escapes' END AS out
  FROM (SELECT tree, path, target, CASE WHEN target NOT LIKE '/%' THEN array_to_string(list_reduce(list_prepend([]::VARCHAR[], list_transform(string_split(regexp_replace('./' || path, '/[^/]*$', '') || '/' || target, '/'), lambda x: [x])),
    lambda a, b: CASE WHEN b[1] IN ('', '.') THEN a WHEN b[1] = '..' AND len(a) > 0 AND a[-1] <> '..' THEN a[1:len(a) - 1] ELSE a || b END), '/') END AS goal FROM en WHERE kind = 'link')
), bu AS MATERIALIZED (
  SELECT k AS build, tree, CASE WHEN k % 12 = 0 THEN '' ELSE host END AS dir, k % 18 = 12 AS complete, 'arch-' || (k % 5) AS platform, content_key AS pinned, host, path FROM p WHERE k % 6 = 0
)"""


def resolved_sql(asked: str) -> str:
    """CTEs up to rs (tree, path, resolved, kind, target, links, state) for the paths of the CTE ``asked``."""
    return f"""
rc AS (
  SELECT tree, path, path AS loc, []::VARCHAR[] AS links, NULL::VARCHAR AS target, NULL::VARCHAR AS state FROM {asked}
  UNION ALL
  SELECT tree, path, CASE WHEN hit IS NULL OR len(links) >= 40 OR hit.link = loc OR hit.out IS NOT NULL THEN loc WHEN hit.goal = '' THEN substring(loc, length(hit.link) + 2) ELSE hit.goal || '/' || substring(loc, length(hit.link) + 2) END,
    CASE WHEN hit IS NULL OR len(links) >= 40 THEN links ELSE list_append(links, hit.link) END, CASE WHEN len(links) < 40 AND hit.link = loc THEN hit.target END,
    CASE WHEN hit IS NULL THEN 'plain' WHEN len(links) >= 40 THEN 'loop' WHEN hit.link = loc THEN 'link' ELSE hit.out END
  FROM (SELECT r.tree, r.path, r.loc, r.links, arg_min({{'link': l.link, 'goal': l.goal, 'out': l.out, 'target': l.target}}, length(l.link)) AS hit
        FROM rc r LEFT JOIN lk l ON l.tree = r.tree AND starts_with(r.loc || '/', l.link || '/') WHERE r.state IS NULL GROUP BY r.tree, r.path, r.loc, r.links)
), rs AS MATERIALIZED (
  SELECT r.tree, r.path, CASE WHEN r.state IN ('plain', 'link') THEN r.loc END AS resolved, r.links, CASE WHEN r.state = 'link' THEN 'link' WHEN r.state = 'plain' THEN f.kind END AS kind, r.target,
    CASE WHEN r.state = 'link' OR r.state = 'plain' AND f.kind IS NOT NULL THEN 'found' WHEN r.state <> 'plain' THEN r.state
         WHEN EXISTS (SELECT 1 FROM en x WHERE x.tree = r.tree AND x.kind = 'file' AND starts_with(r.loc, x.path || '/')) THEN 'through_file' ELSE 'missing' END AS state
  FROM rc r LEFT JOIN fu f ON f.tree = r.tree AND f.path = r.loc WHERE r.state IS NOT NULL
)"""


CLOSURE = f"""
de AS (
  SELECT build, path FROM (SELECT k AS build, unnest(['go/' || (k + 1), host2 || '/' || leaf2, CASE WHEN k % 42 = 6 THEN 'nope/' || k END]) AS path FROM p WHERE k % 6 = 0 AND k % 12 <> 0 AND host2 IS NOT NULL) WHERE path IS NOT NULL
), fr AS (
  SELECT DISTINCT b.build, p.path AS link FROM bu b JOIN p ON p.tree = b.tree AND p.k % 25 IN (0, 5) WHERE b.build % 30 <> 6
), se AS (
  SELECT build, tree, de.path FROM de JOIN bu USING (build) UNION SELECT build, tree, dir FROM bu WHERE dir <> '' AND NOT complete
), ak AS (
  SELECT DISTINCT tree, path FROM se UNION SELECT tree, goal FROM lk WHERE out IS NULL AND goal <> ''
), {resolved_sql("ak").lstrip()}, re AS MATERIALIZED (
  SELECT * FROM rs UNION ALL
  SELECT DISTINCT tree, resolved, resolved, CASE WHEN kind = 'link' THEN [resolved] ELSE [] END, kind, target, state FROM rs WHERE state = 'found' AND (tree, resolved) NOT IN (SELECT (tree, path) FROM rs)
), ch AS MATERIALIZED (
  SELECT DISTINCT r.tree, r.path, l.link, l.goal, l.out FROM re r JOIN lk l ON l.tree = r.tree AND (r.kind = 'link' AND l.link = r.resolved OR r.kind = 'dir' AND starts_with(l.link, r.resolved || '/')) WHERE r.state = 'found'
), wk AS (
  SELECT build, tree, path FROM se
  UNION SELECT w.build, w.tree, e.goal FROM wk w JOIN (SELECT tree, path, goal FROM ch WHERE out IS NULL UNION SELECT tree, path, resolved FROM re WHERE state = 'found' AND resolved <> path) e ON e.tree = w.tree AND e.path = w.path
), rw AS MATERIALIZED (
  SELECT w.build, w.path, r.links, CASE WHEN w.path = '' THEN 'root' ELSE r.state END AS state, (w.build, w.path) IN (SELECT (build, path) FROM se) AS seed FROM wk w LEFT JOIN re r ON r.tree = w.tree AND r.path = w.path
), co AS MATERIALIZED (
  SELECT build, unnest(links) AS path FROM rw UNION SELECT build, path FROM rw WHERE state = 'found'
), ea AS (
  SELECT build, path, 'missing' AS reason FROM rw WHERE seed AND state = 'missing' UNION SELECT build, path, state FROM rw WHERE state NOT IN ('found', 'missing')
  UNION SELECT w.build, c.link, c.out FROM wk w JOIN ch c ON c.tree = w.tree AND c.path = w.path WHERE c.out IS NOT NULL AND (w.build, c.link) NOT IN (SELECT (build, link) FROM fr)
  UNION SELECT build, '', 'empty' FROM bu WHERE build NOT IN (SELECT build FROM se)
  UNION SELECT build, dir, 'dir' FROM bu b WHERE complete AND dir <> '' AND build IN (SELECT build FROM de)
    AND NOT EXISTS (SELECT 1 FROM co c WHERE c.build = b.build AND (c.path = b.dir OR starts_with(c.path, b.dir || '/') OR starts_with(b.dir, c.path || '/')))
), cl AS MATERIALIZED (
  SELECT build, path, 'error' AS outcome, reason FROM ea
  UNION ALL SELECT build, path, 'covered', NULL FROM co WHERE build NOT IN (SELECT build FROM ea)
  UNION ALL SELECT build, path, 'warning', 'dangling' FROM rw WHERE NOT seed AND state = 'missing' AND build NOT IN (SELECT build FROM ea)
)"""

KEEPS = """
kp AS (
  SELECT k AS build, tree, regexp_replace(path, '^/[.][.]$', '') AS path FROM (SELECT k, tree, unnest([CASE WHEN k % 18 = 6 THEN host END, CASE WHEN k % 4 = 0 THEN path END, CASE WHEN k % 8 = 2 THEN path || '/x' END, CASE WHEN k % 10 = 4 THEN 'no/' || k END, CASE WHEN k % 30 = 0 THEN '/..' END, 'go/' || k]) AS path
    FROM p WHERE k % 6 = 0 AND k % 14 <> 0) WHERE path IS NOT NULL
)"""


def pruned_sql(keep: str) -> str:
    """CTEs up to pr, the entries that the CTE keep (build, tree, path) leaves."""
    return f"""
ks AS (
  SELECT DISTINCT * FROM {keep} a WHERE path <> '' AND NOT EXISTS (SELECT 1 FROM {keep} b WHERE b.build = a.build AND b.path <> '' AND starts_with(a.path, b.path || '/'))
), pi AS (
  SELECT k.build, f.* EXCLUDE tree FROM ks k JOIN fu f ON f.tree = k.tree AND starts_with(f.path || '/', k.path || '/')
), pr AS MATERIALIZED (
  SELECT * FROM pi UNION ALL
  SELECT u.build, f.* EXCLUDE tree FROM (SELECT DISTINCT build, unnest({UP('path')}) AS path FROM pi) u JOIN (SELECT DISTINCT build, tree FROM ks) t USING (build) JOIN fu f ON f.tree = t.tree AND f.path = u.path
  WHERE (u.build, u.path) NOT IN (SELECT (build, path) FROM pi)
)"""


def overlaid_sql(entries: str) -> str:
    """CTEs up to ov and oe, the trees with generated files and what is wrong, over the CTE entries (build, path, ...)."""
    return f"""
gf AS (
  SELECT k AS build, CASE WHEN k % 7 < 3 THEN host || '/gen/new' WHEN k % 7 = 3 THEN path WHEN k % 7 = 4 THEN path || '/sub' WHEN k % 7 = 5 THEN host ELSE '' END AS path, sha256(content_key) AS content_key FROM p WHERE k % 6 = 0
), ov AS (
  SELECT e.*, 'kept' AS origin FROM {entries} e WHERE (build, path) NOT IN (SELECT (build, path) FROM gf)
  UNION ALL SELECT g.build, g.path, 'file', 292, g.content_key, NULL, CASE WHEN EXISTS (SELECT 1 FROM {entries} e WHERE e.build = g.build AND e.path = g.path) THEN 'replaced' ELSE 'added' END FROM gf g
  UNION ALL SELECT build, path, 'dir', 365, NULL, NULL, 'made' FROM (SELECT build, unnest({UP('path')}) AS path FROM gf) WHERE path <> '' AND (build, path) NOT IN (SELECT (build, path) FROM {entries})
), oe AS (
  SELECT build, path, 'root' AS reason FROM gf WHERE path = ''
  UNION SELECT g.build, g.path, 'directory' FROM gf g JOIN {entries} e ON e.build = g.build AND e.path = g.path AND e.kind = 'dir'
  UNION SELECT g.build, g.path, 'through_file' FROM gf g JOIN {entries} e ON e.build = g.build AND e.kind <> 'dir' AND starts_with(g.path, e.path || '/')
)"""


def merkle_sql(entries: str) -> str:
    """CTEs up to mk (tree, path, digest) over the CTE entries (tree, path, kind, mode, content_key, target)."""
    return f"""
lv AS MATERIALIZED (
  SELECT tree, path, kind, concat_ws(chr(9), kind, mode, '0', '0', '315532800000000000') AS meta, coalesce(content_key, target, '') AS digest, len(string_split(path, '/')) AS depth FROM {entries}
), mk AS (
  SELECT max(depth) + 1 AS depth, NULL::BIGINT AS tree, NULL::VARCHAR AS path, NULL::VARCHAR AS digest FROM lv
  UNION ALL
  SELECT depth, tree, dir, sha256(string_agg(part || digest, chr(10) ORDER BY part || digest)) FROM (
    SELECT depth, tree, dir, part, sha256(string_agg(line, chr(10) ORDER BY line)) AS digest FROM (
      SELECT depth, tree, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS dir, left(sha256(string_split(path, '/')[-1]), 3) AS part, concat_ws(chr(9), string_split(path, '/')[-1], meta, digest) AS line
      FROM (SELECT m.depth - 1 AS depth, m.tree, m.path, m.digest, coalesce(l.meta, concat_ws(chr(9), 'dir', '365', '0', '0', '315532800000000000')) AS meta FROM mk m LEFT JOIN lv l ON l.tree = m.tree AND l.path = m.path AND l.kind = 'dir' WHERE m.path IS NOT NULL AND m.path <> ''
            UNION ALL SELECT k.depth, l.tree, l.path, l.digest, l.meta FROM (SELECT DISTINCT depth - 1 AS depth FROM mk WHERE depth > 1) k JOIN lv l ON l.depth = k.depth AND (l.kind <> 'dir' OR (l.tree, l.path) NOT IN (SELECT (tree, unnest({UP('path')})) FROM lv)))
    ) GROUP BY depth, tree, dir, part
  ) GROUP BY depth, tree, dir
)"""


SQL = {
    "resolve_links": f"WITH RECURSIVE {trees_sql()}, aq AS (SELECT DISTINCT tree, unnest([path, 'go/' || k || '/' || leaf, path || '/x', path || '/' || coalesce(leaf2, 'none')]) AS path FROM p), {resolved_sql('aq')} SELECT tree, path, resolved, kind, target, array_to_string(links, ' ') AS links, state FROM rs",
    "covered_paths": f"WITH RECURSIVE {trees_sql(6)}, {CLOSURE} SELECT build, path, outcome, reason FROM cl",
    "prune_trees": f"WITH RECURSIVE {trees_sql()}, {KEEPS}, {pruned_sql('kp')} SELECT * FROM pr",
    "prune_errors": f"""WITH RECURSIVE {trees_sql()}, {KEEPS}, {pruned_sql('kp')}, lo AS (SELECT * FROM ks WHERE (tree, path) NOT IN (SELECT (tree, path) FROM fu)) SELECT build, '/..' AS path, 'root' AS reason FROM kp WHERE path = '' UNION SELECT build, '', 'empty' FROM bu WHERE build NOT IN (SELECT build FROM kp)
      UNION SELECT build, path, CASE WHEN EXISTS (SELECT 1 FROM en x WHERE x.tree = lo.tree AND starts_with(lo.path, x.path || '/')) THEN 'through_file' ELSE 'missing' END FROM lo""",
    "overlay_trees": f"WITH RECURSIVE {trees_sql()}, wh AS (SELECT b.build, f.* EXCLUDE tree FROM bu b JOIN fu f ON f.tree = b.tree), {overlaid_sql('wh')} SELECT * FROM ov",
    "overlay_errors": f"WITH RECURSIVE {trees_sql()}, wh AS (SELECT b.build, f.* EXCLUDE tree FROM bu b JOIN fu f ON f.tree = b.tree), {overlaid_sql('wh')} SELECT * FROM oe",
    "merkle_trees": f"WITH RECURSIVE {trees_sql()}, {merkle_sql('en')} SELECT tree, path, digest FROM mk WHERE path IS NOT NULL",
    "cover_identity": f"""WITH RECURSIVE {trees_sql(6)}, {CLOSURE}, kc AS (SELECT c.build, b.tree, c.path FROM cl c JOIN bu b USING (build) WHERE outcome = 'covered'), {pruned_sql('kc')},
      wn AS (SELECT build, tree FROM bu WHERE dir = '' AND NOT complete AND build NOT IN (SELECT build FROM de)), pa AS MATERIALIZED (SELECT * FROM pr UNION ALL SELECT w.build, f.* EXCLUDE tree FROM wn w JOIN fu f ON f.tree = w.tree), {overlaid_sql('pa')},
      ot AS MATERIALIZED (SELECT build AS tree, path, kind, mode, content_key, target FROM ov), {merkle_sql('ot')}, pb AS (SELECT build, min(problem) AS problem FROM (
        SELECT build, 'cover: ' || reason || CASE WHEN path = '' THEN '' ELSE ' ' || path END AS problem FROM cl WHERE outcome = 'error' AND build NOT IN (SELECT build FROM wn)
        UNION ALL SELECT build, 'overlay: ' || reason || CASE WHEN path = '' THEN '' ELSE ' ' || path END FROM oe) GROUP BY build)
      SELECT b.build, CASE WHEN problem IS NULL THEN sha256(concat_ws(chr(10), sha256(pinned), platform, '2', digest)) END AS identity, CASE WHEN problem IS NULL THEN digest END AS tree_key, problem
      FROM bu b LEFT JOIN pb USING (build) LEFT JOIN (SELECT tree, digest FROM mk WHERE path = '') r ON r.tree = b.build""",
}
