"""Queries over links, files, packages, projects and record rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitesift.functions import geometry as G
from sitesift.functions import text as X
from sitesift.operators import links, manifests, projects, rules
from sitesift.plans.bindings import Source
from sitesift.plans.registry import query, scalar


def joined(column: str = "violations") -> F.Column:
    return F.array_join(column, ",").alias(column)


# -- links ------------------------------------------------------------------

MAPS = """SELECT p_partkey % 2 AS doc, CONCAT('m', CAST(p_partkey AS STRING)) AS style_id,
  CASE WHEN p_partkey % 97 = 5 THEN CONCAT('m', CAST(p_partkey AS STRING))
    WHEN p_partkey % 5 <> 0 AND p_partkey >= 2 THEN CONCAT('m', CAST(p_partkey - 2 AS STRING))
    ELSE CONCAT('s', CAST(p_partkey AS STRING)) END AS target FROM part"""
STYLES = """SELECT p_partkey % 2 AS doc, CONCAT('s', CAST(p_partkey AS STRING)) AS style_id,
  p_brand AS color, p_size / 100e0 AS opacity FROM part WHERE p_partkey % 3 <> 0"""


@query("resolve_styles", f"""
WITH RECURSIVE m AS ({MAPS}), s AS ({STYLES}),
walk AS (SELECT doc, style_id, target, 0 AS n FROM m
  UNION ALL SELECT w.doc, w.style_id, m.target, n + 1 FROM walk w JOIN m ON m.doc = w.doc AND m.style_id = w.target AND m.target <> m.style_id),
ends AS (SELECT DISTINCT w.doc, w.style_id, s.color, s.opacity FROM walk w JOIN s ON s.doc = w.doc AND s.style_id = w.target)
SELECT m.doc, m.style_id, e.color, e.opacity FROM m LEFT JOIN ends e ON e.doc = m.doc AND e.style_id = m.style_id
UNION ALL SELECT * FROM s
""")
def resolve_styles(s: Source) -> DataFrame:
    return links.resolve_styles(s.sql(STYLES), s.sql(MAPS))


@query("reachable_documents", """
WITH RECURSIVE walk AS (SELECT doc_id AS doc, 0 AS depth FROM b_links WHERE parent_id IS NULL
  UNION ALL SELECT l.doc_id, w.depth + 1 FROM walk w JOIN b_links l ON l.parent_id = w.doc
  WHERE l.doc_id % 11 <> 7),
found AS (SELECT doc, CAST(MIN(depth) AS INT) AS depth FROM walk GROUP BY doc)
SELECT CAST(0 AS BIGINT) AS root_id, doc, depth,
  (SELECT MAX(depth) <= 3 AND COUNT(*) <= 600 FROM found) AS within_limits FROM found
""")
def reachable_documents(s: Source) -> DataFrame:
    edges = s.view("b_links").where("parent_id IS NOT NULL").select(
        F.col("parent_id").alias("parent"), F.col("doc_id").alias("doc"),
        F.when(F.col("doc_id") % 11 == 7, G.bounds(50.0, 50.0, 51.0, 51.0)).alias("region"))
    roots = s.view("b_links").where("parent_id IS NULL").select(
        F.col("doc_id").alias("root_id"), F.col("doc_id").alias("doc"))
    view = G.bounds(-95.0, 41.0, -74.0, 57.0)
    return links.reachable_documents(edges, roots, view, max_depth=3)


LINK_TEXT = """SELECT page_id, url, CASE WHEN page_id % 9 = 0 THEN ' Surficial Geology ' ELSE 'Tile' END AS name,
  CASE page_id % 4 WHEN 0 THEN CONCAT(url, '/mrd128/polygons/a.KMZ') WHEN 1 THEN CONCAT(url, '/mrd128/polygons/a.txt')
    WHEN 2 THEN 'mrd128-cache/polygons/b.kml?x=1' ELSE CONCAT(url, '/x.kml') END AS href,
  CONCAT('files/t', CAST(page_id AS STRING), CASE WHEN page_id % 3 = 0 THEN '.JSON' WHEN page_id % 3 = 1 THEN '.json' ELSE '/a.json' END) AS cache_path,
  CASE page_id % 7 WHEN 0 THEN '../a.png' WHEN 1 THEN 'images/con.png' WHEN 2 THEN '/abs.png' WHEN 3 THEN 'images//a.png'
    WHEN 4 THEN 'images/ok-1.png' WHEN 5 THEN 'a/b./c.png' ELSE 'Project.dxf' END AS zip_path FROM pages"""

scalar("follow_link", LINK_TEXT, ["page_id"], lambda: {"follow": X.follow_link("name", "href")},
       {"follow": "(page_id % 9 = 0 OR page_id % 4 IN (0, 2))"})
scalar("cache_path_ok", LINK_TEXT, ["page_id"], lambda: {"ok": X.cache_path_ok("cache_path")},
       {"ok": "(page_id % 3 = 1)"})
scalar("archive_path_ok", LINK_TEXT, ["page_id"], lambda: {"ok": X.archive_path_ok("zip_path")},
       {"ok": "(page_id % 7 IN (4, 6))"})

URLS = """SELECT page_id, CONCAT(CASE WHEN page_id % 3 = 0 THEN url ELSE REPLACE(url, 'http://', 'https://') END,
  CASE page_id % 8 WHEN 1 THEN '#frag' WHEN 2 THEN '&y=%2e%2e' ELSE '' END) AS url0, page_id % 8 AS k, url AS raw FROM pages"""
URLS = f"""SELECT page_id, k, raw, CASE k WHEN 3 THEN REPLACE(url0, '://', '://me@') WHEN 4 THEN REPLACE(url0, '.com/', '.com/%252e%252e/')
  WHEN 5 THEN REPLACE(url0, '.com/', '.com/a%5cb/') WHEN 6 THEN REPLACE(url0, '.com/', '.com/tile/{{z}}/') ELSE url0 END AS url FROM ({URLS}) u"""

scalar("url_allowed", URLS, ["page_id"],
       lambda: {"ok": X.url_allowed("url"),
                "in_roots": X.url_allowed("url", F.array(X.url_origin("url")), F.array(
                    F.concat(X.url_origin("url"), F.lit("/fr/")), F.concat(X.url_origin("url"), F.lit("/tile/"))), template=True)},
       {"ok": "(url LIKE 'https://%' AND strpos(url, '#') = 0 AND strpos(url, 'me@') = 0 AND strpos(url, '%252e') = 0 AND strpos(url, '%5c') = 0)",
        "in_roots": "(url LIKE 'https://%' AND strpos(url, '#') = 0 AND strpos(url, 'me@') = 0 AND strpos(url, '%252e') = 0 AND strpos(url, '%5c') = 0 AND "
                    "(regexp_extract(url, '^https://[^/?#]+(/[^?#]*)', 1) LIKE '/fr/%' OR "
                    "regexp_extract(url, '^https://[^/?#]+(/[^?#]*)', 1) LIKE '/tile/%'))"})

# -- files and packages -----------------------------------------------------

FILES = """SELECT CONCAT('files/Doc-', CAST(doc_id AS STRING), '.txt') AS path, text AS content, n_chars AS bytes FROM documents
  UNION ALL SELECT CONCAT('FILES/DOC-', CAST(doc_id AS STRING), '.TXT'), text, n_chars FROM documents WHERE doc_id % 50 = 0"""
REFS = """SELECT CONCAT('files/doc-', CAST(l.doc_id + CASE WHEN l.doc_id % 13 = 0 THEN 5000000 ELSE 0 END AS STRING), '.txt') AS path,
  d.n_chars + CASE WHEN l.doc_id % 9 = 0 THEN 1 ELSE 0 END AS bytes, d.text AS content
  FROM labels l JOIN documents d ON d.doc_id = l.doc_id"""


@query("hash_inventory", f"""
SELECT path, sha256(content) AS sha256, CAST(strlen(content) AS BIGINT) AS bytes FROM ({FILES}) f
""")
def hash_inventory(s: Source) -> DataFrame:
    return manifests.hash_inventory(s.sql(FILES))


@query("duplicate_ids", f"SELECT lower(path) AS path, COUNT(*) AS n FROM ({FILES}) f GROUP BY 1 HAVING COUNT(*) > 1")
def duplicate_ids(s: Source) -> DataFrame:
    return manifests.duplicate_ids(s.sql(FILES).withColumn("path", F.lower("path")), "path")


@query("reconcile_manifest", f"""
WITH f AS (SELECT lower(path) AS p, COUNT(*) AS n, MIN(bytes) AS b, MIN(sha256(content)) AS h FROM ({FILES}) x GROUP BY 1),
r AS (SELECT lower(path) AS p, MIN(bytes) AS b, MAX(bytes) AS b2, MIN(sha256(content)) AS h, MAX(sha256(content)) AS h2 FROM ({REFS}) x GROUP BY 1)
SELECT COALESCE(f.p, r.p) AS path_key, CASE WHEN f.p IS NULL THEN 'missing' WHEN f.n > 1 THEN 'duplicate'
  WHEN r.p IS NULL THEN 'unreferenced' WHEN r.b = f.b AND r.b2 = f.b AND r.h = f.h AND r.h2 = f.h THEN 'ok' ELSE 'mismatch' END AS status
FROM f FULL OUTER JOIN r ON r.p = f.p
""")
def reconcile_manifest(s: Source) -> DataFrame:
    hashed = lambda df: df.select("path", "bytes", F.sha2("content", 256).alias("sha256"))
    return manifests.reconcile_manifest(hashed(s.sql(FILES)), hashed(s.sql(REFS)))


@query("unreferenced_assets", """
SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
""")
def unreferenced_assets(s: Source) -> DataFrame:
    return manifests.unreferenced_assets(s.table("documents"), s.table("labels"), "doc_id").select("doc_id", "source")


REFERENCES = """SELECT o_custkey AS asset_id, CASE WHEN o_orderkey % 211 = 0 THEN 'company-logo' ELSE 'historical-image' END AS kind,
  o_custkey AS owner_id, CONCAT('r', CAST(o_orderkey AS STRING)) AS reference_id, 100 + o_custkey % 7 AS width,
  100 + CASE WHEN o_orderkey % 157 = 0 THEN 1 ELSE 0 END AS height FROM orders"""


@query("reference_lists", f"""
WITH r AS ({REFERENCES}), t AS (SELECT asset_id, COUNT(*) AS n, (MIN(kind) <> MAX(kind) OR MIN(width) <> MAX(width)
  OR MIN(height) <> MAX(height)) AS conflict FROM r GROUP BY 1)
SELECT r.asset_id, kind, reference_id, ROW_NUMBER() OVER (PARTITION BY r.asset_id ORDER BY reference_id) AS pos,
  n AS n_references, conflict FROM r JOIN t ON t.asset_id = r.asset_id
""")
def reference_lists(s: Source) -> DataFrame:
    return manifests.reference_lists(s.sql(REFERENCES)).drop("owner_id")


LAYERS = """SELECT o_custkey AS item_id, o_orderkey AS ord, o_orderpriority AS name, CONCAT('by ', o_orderstatus) AS attribution,
  CONCAT('lic ', CAST(o_orderkey % 3 AS STRING)) AS license, 'e' AS evidence FROM orders"""


@query("aggregate_provenance", f"""
WITH l AS ({LAYERS}), g AS (SELECT item_id, COUNT(*) AS n, string_agg(name, ' + ' ORDER BY ord) AS provider,
  string_agg(attribution, ' | ' ORDER BY ord) AS attribution, string_agg(license, ' | ' ORDER BY ord) AS license FROM l GROUP BY 1)
SELECT item_id, provider, attribution, license, CASE WHEN n > 20 THEN 'too-many-layers' END AS error FROM g
""")
def aggregate_provenance(s: Source) -> DataFrame:
    return manifests.aggregate_provenance(s.sql(LAYERS), "item_id").drop("evidence")


RASTERS = """SELECT o_custkey AS package_id, 1000 + o_orderkey % 3200 AS width, 1000 + (o_orderkey * 7) % 4100 AS height FROM orders"""
PACKAGES = """SELECT c_custkey AS package_id, CAST(100000 AS BIGINT) AS logo_bytes, CAST(90000 AS BIGINT) AS logo_pixels,
  CAST(8 AS BIGINT) AS entry_count, CAST(CASE WHEN c_custkey % 17 = 0 THEN 65000000 ELSE 64000000 END AS BIGINT) AS pdf_bytes, CAST(8000000 AS BIGINT) AS text_bytes FROM customer"""


@query("package_budget", f"""
WITH r AS ({RASTERS}), p AS ({PACKAGES}),
t AS (SELECT p.*, COALESCE(SUM(width * height), 0) AS px, COUNT(width) AS n, COALESCE(MAX(width * height), 0) AS big
  FROM p LEFT JOIN r ON r.package_id = p.package_id GROUP BY ALL),
u AS (SELECT *, px + logo_pixels AS tp, logo_bytes + n * 16000000 AS rb, logo_bytes + n * 16000000 + pdf_bytes + text_bytes AS ub FROM t),
v AS (SELECT *, ub + entry_count * 1024 + 1024 AS ab FROM u)
SELECT package_id, CAST(tp AS BIGINT) AS total_pixels, CAST(ab AS BIGINT) AS archive_bytes, concat_ws(',',
  CASE WHEN big > 16000000 THEN 'image-pixels' END, CASE WHEN tp > 160000000 THEN 'pixels' END,
  CASE WHEN rb > 128000000 THEN 'raster-bytes' END, CASE WHEN pdf_bytes > 64000000 THEN 'pdf-bytes' END,
  CASE WHEN ub > 256000000 THEN 'uncompressed-bytes' END, CASE WHEN ab > 257000000 THEN 'archive-bytes' END,
  CASE WHEN tp * 4 + rb + pdf_bytes + ub + ab > 768000000 THEN 'working-bytes' END) AS overruns FROM v
""")
def package_budget(s: Source) -> DataFrame:
    return manifests.package_budget(s.sql(RASTERS), s.sql(PACKAGES)).select(
        "package_id", "total_pixels", "archive_bytes", joined("overruns"))


COUNTS = """SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey % 5 + 90 END AS expected,
  s_suppkey % 3 + 90 AS saved, s_suppkey % 3 + 90 AS listed, s_suppkey % 4 % 2 AS failed, 0 AS pending FROM supplier"""


@query("cache_complete", f"""
SELECT id, (failed = 0 AND CASE WHEN expected IS NULL THEN saved >= 2 ELSE saved = expected END) AS complete FROM ({COUNTS}) c
""")
def cache_complete(s: Source) -> DataFrame:
    return manifests.cache_complete(s.sql(COUNTS)).select("id", "complete")


@query("sort_manifest", f"SELECT path, bytes FROM ({FILES}) f ORDER BY path")
def sort_manifest(s: Source) -> DataFrame:
    return manifests.sort_manifest(s.sql(FILES).select("path", "bytes"))


NAMED = """SELECT p_partkey % 40 AS package_id, p_partkey AS id, p_name AS label,
  CASE WHEN p_partkey % 3 = 0 THEN 'image/jpeg' ELSE 'image/png' END AS mime FROM part"""


@query("allocate_filenames", f"""
WITH n AS (SELECT *, regexp_replace(label, '[^A-Za-z0-9]+', '-', 'g') AS stem FROM ({NAMED}) x),
k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY package_id, lower(stem) ORDER BY id) AS c FROM n)
SELECT package_id, id, 'images/' || stem || CASE WHEN c > 1 THEN '-' || c ELSE '' END || CASE mime WHEN 'image/png' THEN '.png' ELSE '.jpg' END AS path,
  'images/' || stem || CASE WHEN c > 1 THEN '-' || c ELSE '' END || CASE mime WHEN 'image/png' THEN '.pgw' ELSE '.jgw' END AS world_path FROM k
""")
def allocate_filenames(s: Source) -> DataFrame:
    return manifests.allocate_filenames(s.sql(NAMED))


#: Stems that repeat, and natural names that read like their numbered ones, before and after them.
COLLIDING = """SELECT p_partkey % 40 AS package_id, p_partkey AS id,
  CASE WHEN p_partkey % 7 < 3 THEN 'plan' WHEN p_partkey % 7 = 3 THEN CONCAT('plan-', CAST(p_partkey % 13 + 2 AS STRING))
    WHEN p_partkey % 7 = 4 THEN CONCAT('Plan-2-', CAST(p_partkey % 3 + 1 AS STRING)) WHEN p_partkey % 7 = 5 THEN 'plan-2' ELSE p_name END AS label,
  CASE WHEN p_partkey % 11 = 0 THEN 'image/jpeg' ELSE 'image/png' END AS mime FROM part"""


@query("allocate_colliding_filenames", f"""
WITH RECURSIVE n AS (SELECT *, regexp_replace(label, '[^A-Za-z0-9]+', '-', 'g') AS stem, CASE mime WHEN 'image/png' THEN '.png' ELSE '.jpg' END AS ext,
  ROW_NUMBER() OVER (PARTITION BY package_id ORDER BY id) AS step FROM ({COLLIDING}) x),
walk AS (
  SELECT n.package_id, n.id, n.step, n.stem, n.ext, CAST(1 AS BIGINT) AS c, [lower(n.stem || n.ext)] AS used, [{{'s': lower(n.stem), 'c': CAST(1 AS BIGINT)}}] AS tops
  FROM n WHERE step = 1
  UNION ALL
  SELECT package_id, id, step, stem, ext, c, list_append(used, lower(stem || CASE WHEN c > 1 THEN '-' || c ELSE '' END || ext)),
    list_append(tops, {{'s': lower(stem), 'c': c}})
  FROM (SELECT n.package_id, n.id, n.step, n.stem, n.ext, w.used, w.tops, list_min(list_filter(
      range(1, n.step + n.step + 2),
      lambda i: i > COALESCE(list_max(list_transform(list_filter(w.tops, lambda t: t.s = lower(n.stem)), lambda t: t.c)), 0)
        AND NOT list_contains(w.used, lower(n.stem || CASE WHEN i > 1 THEN '-' || i ELSE '' END || n.ext)))) AS c
    FROM walk w JOIN n ON n.package_id = w.package_id AND n.step = w.step + 1) q)
SELECT package_id, id, 'images/' || stem || CASE WHEN c > 1 THEN '-' || c ELSE '' END || ext AS path,
  'images/' || stem || CASE WHEN c > 1 THEN '-' || c ELSE '' END || CASE ext WHEN '.png' THEN '.pgw' ELSE '.jgw' END AS world_path FROM walk
""")
def allocate_colliding_filenames(s: Source) -> DataFrame:
    return manifests.allocate_filenames(s.sql(COLLIDING))


FILE_ROWS = """SELECT doc_id, CONCAT(CASE WHEN doc_id % 10 = 0 THEN 'company/' ELSE 'images/' END, 'f', CAST(doc_id AS STRING),
    CASE WHEN doc_id % 3 = 0 THEN '.png' ELSE '.txt' END) AS path,
  CASE WHEN doc_id % 3 = 0 THEN 'image/png' WHEN doc_id % 7 = 0 THEN 'text/html' ELSE 'text/plain' END AS mime,
  CASE WHEN doc_id % 11 = 0 THEN 'ABC' ELSE 'aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa' END AS sha256,
  n_chars AS bytes, CASE WHEN doc_id % 3 = 0 THEN 640 END AS pixel_width, CASE WHEN doc_id % 6 = 0 THEN 480 END AS pixel_height,
  CASE WHEN doc_id % 3 = 0 AND doc_id % 5 <> 0 THEN CONCAT('images/f', CAST(doc_id AS STRING), '.pgw') END AS world_file_path FROM documents"""


@query("validate_files", f"""
SELECT doc_id, concat_ws(',', CASE WHEN doc_id % 3 <> 0 AND doc_id % 7 = 0 THEN 'media-type' END,
  CASE WHEN doc_id % 11 = 0 THEN 'sha256' END, CASE WHEN bytes < 1 THEN 'bytes' END,
  CASE WHEN doc_id % 3 = 0 AND doc_id % 6 <> 0 THEN 'pixels' END,
  CASE WHEN doc_id % 3 = 0 AND doc_id % 10 <> 0 AND world_file_path IS NULL THEN 'world-file' END) AS violations
FROM ({FILE_ROWS}) f
""")
def validate_files(s: Source) -> DataFrame:
    return manifests.validate_files(s.sql(FILE_ROWS)).select("doc_id", joined())


ITEM_ROWS = """SELECT doc_id, CONCAT('H-', CAST(1900 + doc_id % 100 AS STRING), '-', CAST(doc_id + 1 AS STRING)) AS code,
  CAST(CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 11 = 0 THEN 1800 ELSE 1900 + doc_id % 100 END AS INT) AS year,
  CASE WHEN doc_id % 14 = 0 THEN 'unknown' ELSE 'unverified' END AS verification, doc_id % 4 AS k FROM documents"""


@query("validate_items", f"""
SELECT doc_id, concat_ws(',', CASE WHEN (year IS NULL AND doc_id % 14 <> 0) THEN 'verification' END,
  CASE WHEN doc_id % 7 = 0 OR doc_id % 11 = 0 THEN 'year-differs-from-code' END,
  CASE WHEN k = 1 THEN 'not-perpendicular' END, CASE WHEN k = 1 OR k = 2 THEN 'pixel-scale' END,
  CASE WHEN k = 3 THEN 'rotation' END) AS violations FROM ({ITEM_ROWS}) i
""")
def validate_items(s: Source) -> DataFrame:
    c = F.col
    base = s.sql(ITEM_ROWS)
    path = F.concat(F.lit("images/"), "code", F.lit(".png"))
    skew = F.when(c("k") == 1, 64.0).otherwise(0.0)
    tall = F.when(c("k") == 2, 960.0).otherwise(480.0)
    x, y = F.lit(500000.0), F.lit(4800000.0)
    corners = F.array(G.point(x, y), G.point(x + 640, y), G.point(x + 640 + skew, y - tall), G.point(x + skew, y - tall))
    items = base.select(
        "doc_id", "code", "year", "verification", "k", path.alias("image_path"), corners.alias("corners"),
        F.when(c("k") == 3, 1.0).otherwise(0.0).alias("rotation"), F.lit(0.0).alias("residual_m"),
        F.lit(2.0).alias("tolerance_m"), corners.alias("controls"))
    files = base.select(path.alias("path"), F.lit(640).alias("pixel_width"), F.lit(480).alias("pixel_height"),
                        F.lit("image/png").alias("mime"))
    return manifests.validate_items(items, files).select("doc_id", joined())


# -- projects ---------------------------------------------------------------

ITEMS = "SELECT o_custkey AS project_id, CAST(year(o_orderdate) AS INT) AS year, o_orderkey AS item_id, CAST(o_orderkey % 50 + 1 AS BIGINT) AS sequence FROM orders"
SAVED = "SELECT c_custkey AS project_id, CAST(1994 + c_custkey % 4 AS INT) AS year, CAST(c_custkey % 60 AS BIGINT) AS counter FROM customer"


@query("sequence_counters", f"""
SELECT project_id, year, MAX(v) AS counter FROM (SELECT project_id, year, counter AS v FROM ({SAVED}) a
  UNION ALL SELECT project_id, year, sequence FROM ({ITEMS}) b) c GROUP BY 1, 2
""")
def sequence_counters(s: Source) -> DataFrame:
    return projects.sequence_counters(s.sql(ITEMS), s.sql(SAVED))


@query("next_sequence", f"""
WITH i AS ({ITEMS}), c AS ({SAVED})
SELECT i.project_id, i.year, i.item_id, COALESCE(c.counter, 0)
  + ROW_NUMBER() OVER (PARTITION BY i.project_id, i.year ORDER BY i.item_id) AS sequence
FROM i LEFT JOIN c ON c.project_id = i.project_id AND c.year = i.year
""")
def next_sequence(s: Source) -> DataFrame:
    return projects.next_sequence(s.sql(ITEMS).drop("sequence"), s.sql(SAVED))


CODED = """SELECT o_custkey AS package_id, o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN substr('ABCDE', CAST(o_orderkey % 5 + 1 AS INT), 1)
  ELSE CONCAT('H-', CAST(year(o_orderdate) AS STRING), '-', CAST(o_orderkey + 1 AS STRING)) END AS code FROM orders"""
CODED = f"SELECT DISTINCT package_id, code FROM ({CODED}) c"


@query("sheet_order", f"""
SELECT package_id, code, ROW_NUMBER() OVER (PARTITION BY package_id ORDER BY CASE WHEN length(code) = 1 THEN 0 ELSE 1 END,
  TRY_CAST(regexp_extract(code, '^H-([0-9]+)-', 1) AS INT), TRY_CAST(regexp_extract(code, '-([0-9]+)$', 1) AS BIGINT), code) AS pos FROM ({CODED}) c
""")
def sheet_order(s: Source) -> DataFrame:
    return projects.sheet_order(s.sql(CODED))


# Legends of D and E run on, and so do some dated sheets.
RUN_ON = "CASE WHEN code IN ('D', 'E') THEN 2 + package_id % 3 ELSE package_id % 2 END"


@query("sheet_pages", f"""
WITH o AS (SELECT package_id, code, {RUN_ON} AS continuations, ROW_NUMBER() OVER (PARTITION BY package_id ORDER BY CASE WHEN length(code) = 1 THEN 0 ELSE 1 END,
  TRY_CAST(regexp_extract(code, '^H-([0-9]+)-', 1) AS INT), TRY_CAST(regexp_extract(code, '-([0-9]+)$', 1) AS BIGINT), code) AS pos FROM ({CODED}) c)
SELECT package_id, code, pos, CAST(SUM(continuations + 1) OVER (PARTITION BY package_id ORDER BY pos) - continuations AS BIGINT) AS first_page,
  CAST(SUM(continuations + 1) OVER (PARTITION BY package_id ORDER BY pos) AS BIGINT) AS last_page FROM o
""")
def sheet_pages(s: Source) -> DataFrame:
    ordered = projects.sheet_order(s.sql(CODED)).withColumn("continuations", F.expr(RUN_ON))
    return projects.sheet_pages(ordered).select("package_id", "code", "pos", "first_page", "last_page")


scalar("historical_code", ITEMS, ["item_id"],
       lambda: {"code": X.historical_code("year", F.col("sequence") - 1)},
       {"code": "CASE WHEN sequence > 1 THEN 'H-' || year || '-' || (sequence - 1) END"})

READY = "SELECT DISTINCT o_custkey AS project_id, CAST(year(o_orderdate) AS INT) AS year FROM orders WHERE o_orderstatus = 'F'"


@query("selection_intersect", f"SELECT * FROM ({SAVED}) s WHERE EXISTS (SELECT 1 FROM ({READY}) r WHERE r.project_id = s.project_id AND r.year = s.year)")
def selection_intersect(s: Source) -> DataFrame:
    return projects.selection_intersect(s.sql(SAVED), s.sql(READY), "project_id", "year")


@query("unknown_selection", f"SELECT * FROM ({SAVED}) s WHERE NOT EXISTS (SELECT 1 FROM ({READY}) r WHERE r.project_id = s.project_id AND r.year = s.year)")
def unknown_selection(s: Source) -> DataFrame:
    return projects.unknown_selection(s.sql(SAVED), s.sql(READY), "project_id", "year")


@query("migrate_projects", """
SELECT c_custkey AS project_id, CAST(6 AS INT) AS schema_version, CAST(5 AS INT) AS figures,
  CASE WHEN c_custkey % 3 = 0 THEN CASE WHEN c_custkey % 5 < 3 THEN 100e0 ELSE 250e0 END WHEN c_custkey % 3 = 1 THEN 175e0 ELSE 100e0 END AS b_extent,
  CASE WHEN c_custkey % 2 = 0 THEN 'custom' END AS source_id,
  'A,D' || CASE WHEN c_custkey % 4 < 2 THEN ',h2,h1' ELSE '' END AS selection FROM customer
""")
def migrate_projects(s: Source) -> DataFrame:
    saved = s.sql("""
SELECT c_custkey AS project_id, CASE WHEN c_custkey % 5 = 0 THEN CAST(NULL AS INT) ELSE CAST(c_custkey % 5 AS INT) END AS schema_version, c_name AS name,
  CASE WHEN c_custkey % 3 = 2 THEN map('A', named_struct('title', 'x', 'extent_m', 10D))
    ELSE map('B', named_struct('title', 'y', 'extent_m', CASE WHEN c_custkey % 3 = 0 THEN 250D ELSE 175D END)) END AS figures,
  map('bedrock', named_struct('name', CASE WHEN c_custkey % 2 = 0 THEN 'my.KMZ' ELSE 'table' END, 'source_id', CAST(NULL AS STRING), 'source_name', CAST(NULL AS STRING))) AS geology,
  array(named_struct('id', 'h1', 'year', 1970, 'sequence', 2), named_struct('id', 'h2', 'year', 1970, 'sequence', 1)) AS historical,
  concat(array(named_struct('kind', 'figure', 'key', 'D'), named_struct('kind', 'figure', 'key', 'Z'), named_struct('kind', 'figure', 'key', 'A')),
    CASE WHEN c_custkey % 4 < 2 THEN array(named_struct('kind', 'historical', 'key', 'h1'), named_struct('kind', 'historical', 'key', 'h2'))
      ELSE array(named_struct('kind', 'historical', 'key', 'h9')) END) AS selection
FROM customer""")
    done = projects.migrate_projects(saved)
    return done.select(
        "project_id", "schema_version", F.size("figures").alias("figures"),
        F.col("figures")["B"]["extent_m"].alias("b_extent"), F.col("geology")["bedrock"]["source_id"].alias("source_id"),
        F.array_join(F.transform("selection", lambda v: v["key"]), ",").alias("selection"))


# -- rules ------------------------------------------------------------------

PROJECTS = """
SELECT c_custkey AS project_id, CASE WHEN c_custkey % 7 = 0 THEN ' ' ELSE c_name END AS name,
  CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE 'P-1' END AS project_no,
  CASE WHEN c_custkey % 13 = 0 THEN '2024-02-30' ELSE '2024-02-29' END AS date, 'Main St' AS address,
  CASE WHEN c_custkey % 17 = 0 THEN 95e0 ELSE 43.5e0 END AS lat, -80.25e0 AS lng,
  CASE WHEN c_custkey % 19 = 0 THEN '' ELSE 'Example Ltd' END AS company_name, 'Main St' AS company_address, '1' AS phone,
  'a@example.org' AS email, CASE WHEN c_custkey % 23 = 0 THEN NULL ELSE 'example.org' END AS website,
  CASE WHEN c_custkey % 29 = 0 THEN '' ELSE 'logo' END AS logo_asset_id, 'image/png' AS logo_mime, 10 AS logo_width, 10 AS logo_height,
  CASE WHEN c_custkey % 31 = 0 THEN 2e0 ELSE 1e0 END AS logo_scale, (c_custkey % 2 = 0) AS boundary_ok,
  substr('ABCDEX', CAST(c_custkey % 6 + 1 AS INT), 1) AS figure, (c_custkey % 5 <> 0) AS layer_loaded,
  CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'Till' END AS site_unit FROM customer"""
COMPANY_SQL = """CASE WHEN project_id % 19 = 0 THEN 'company-name' END, CASE WHEN project_id % 23 = 0 THEN 'company-website' END,
  CASE WHEN project_id % 29 = 0 THEN 'company-logo' END, CASE WHEN project_id % 29 = 0 THEN 'company-logo-record' END,
  CASE WHEN project_id % 31 = 0 THEN 'company-logo-placement' END"""
RECORD_SQL = f"""CASE WHEN project_id % 7 = 0 THEN 'project-name' END, CASE WHEN project_id % 11 = 0 THEN 'project-number' END,
  CASE WHEN project_id % 13 = 0 THEN 'project-date' END, CASE WHEN project_id % 17 = 0 THEN 'location' END"""


@query("validate_company", f"SELECT project_id, concat_ws(',', {COMPANY_SQL}) AS violations FROM ({PROJECTS}) p")
def validate_company(s: Source) -> DataFrame:
    return rules.validate_company(s.sql(PROJECTS)).select("project_id", joined())


@query("print_requirements", f"""
SELECT project_id, concat_ws(',', {RECORD_SQL}, CASE WHEN figure = 'X' THEN 'figure' END, {COMPANY_SQL},
  CASE WHEN figure = 'B' AND NOT boundary_ok THEN 'site-boundary' END,
  CASE WHEN figure = 'D' AND NOT layer_loaded THEN 'surficial-layer' END, CASE WHEN figure = 'D' AND site_unit IS NULL THEN 'surficial-unit' END,
  CASE WHEN figure = 'E' AND NOT layer_loaded THEN 'bedrock-layer' END, CASE WHEN figure = 'E' AND site_unit IS NULL THEN 'bedrock-unit' END) AS violations
FROM ({PROJECTS}) p
""")
def print_requirements(s: Source) -> DataFrame:
    return rules.print_requirements(s.sql(PROJECTS)).select("project_id", joined())


@query("sheet_readiness", f"""
WITH p AS ({PROJECTS}), f AS (SELECT p.*, t.code FROM p, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) t(code)),
d AS (SELECT *, CASE WHEN code = 'D' THEN project_id % 3 <> 0 WHEN code = 'E' THEN project_id % 4 <> 0 END AS known,
  CASE WHEN code = 'D' THEN project_id % 3 = 1 WHEN code = 'E' THEN project_id % 4 = 1 END AS covers FROM f)
SELECT project_id, code AS figure, concat_ws(',', CASE WHEN project_id % 17 = 0 THEN 'sheet-bounds' END,
  CASE WHEN known AND NOT covers THEN 'sheet-not-covered' END, CASE WHEN code = 'B' AND NOT boundary_ok THEN 'site-boundary' END,
  CASE WHEN code = 'D' AND NOT (known AND covers) THEN 'surficial-layer' END, CASE WHEN code = 'D' AND project_id % 5 = 0 THEN 'surficial-unit' END,
  CASE WHEN code = 'E' AND NOT (known AND covers) THEN 'bedrock-layer' END, CASE WHEN code = 'E' AND project_id % 6 = 0 THEN 'bedrock-unit' END) AS reasons,
  concat_ws(',', {RECORD_SQL}, {COMPANY_SQL}) AS warnings FROM d
""")
def sheet_readiness(s: Source) -> DataFrame:
    c = F.col
    base = s.sql(PROJECTS).drop("figure", "layer_loaded", "site_unit").withColumn(
        "bounds", G.bounds(-80.5, 43.25, -80.0, 43.75))
    ids = base.select("project_id")
    kinds = [("surficial", 3, 5), ("bedrock", 4, 6)]
    near, wide = G.bounds(-80.25, 43.0, -80.0, 44.0), G.bounds(-81.0, 43.0, -79.0, 44.0)
    datasets = units = None
    for kind, m, u in kinds:
        d = ids.where(c("project_id") % m != 0).select(
            "project_id", F.lit(kind).alias("kind"), F.lit("Official").alias("source_name"),
            F.when(c("project_id") % m == 1, wide).otherwise(near).alias("coverage"))
        n = ids.where(c("project_id") % u != 0).select(
            "project_id", F.lit(kind).alias("kind"), F.lit("Till").alias("site_unit"))
        datasets = d if datasets is None else datasets.union(d)
        units = n if units is None else units.union(n)
    found = rules.sheet_readiness(base, datasets, units)
    return found.select("project_id", "figure", joined("reasons"), joined("warnings"))


HISTORY = """
SELECT o_orderkey AS item_no, o_custkey AS project_id, CASE WHEN o_orderkey % 5 = 0 THEN 'manual' ELSE 'official' END AS mode,
  CASE WHEN o_orderkey % 7 = 0 THEN 'unknown' ELSE 'exportable' END AS policy,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN 'gone' ELSE 'napl' END AS provider_id,
  CASE WHEN o_orderkey % 13 = 0 THEN 'https://maps.example.org/napl/old' ELSE 'https://maps.example.org/napl/licence' END AS license_url,
  CASE WHEN o_orderkey % 17 = 0 THEN 'https://other.example.org/napl/a' ELSE 'https://maps.example.org/napl/a' END AS source_url,
  CASE WHEN o_orderkey % 19 = 0 THEN 100 ELSE 4096 END AS max_width,
  CASE WHEN o_orderkey % 5 = 0 AND o_orderkey % 2 = 0 THEN NULL ELSE 'asset' END AS asset_id, CAST(year(o_orderdate) AS INT) AS year,
  o_orderkey % 3 AS sequence FROM orders"""


@query("historical_readiness", f"""
WITH h AS ({HISTORY}), k AS (SELECT *, (mode = 'official' AND provider_id = 'napl') AS known FROM h)
SELECT item_no, concat_ws(',', CASE WHEN policy <> 'exportable' THEN 'item-policy' END,
  CASE WHEN provider_id = 'gone' THEN 'provider-unknown' END, CASE WHEN known AND item_no % 13 = 0 THEN 'licence-changed' END,
  CASE WHEN known AND item_no % 17 = 0 THEN 'source-url' END, CASE WHEN known AND item_no % 17 = 0 THEN 'export-url' END,
  CASE WHEN known AND max_width < 256 THEN 'export-unusable' END,
  CASE WHEN mode = 'manual' AND asset_id IS NULL THEN 'asset-missing' END) AS reasons FROM k
""")
def historical_readiness(s: Source) -> DataFrame:
    from sitesift.functions import geodesy as D

    c = F.col
    half = 0.01
    centre = D.web_mercator(F.lit(-80.25), F.lit(43.5))
    north = D.inv_web_mercator(centre["x"], centre["y"] + half * 2 * D.MERCATOR_RADIUS * D.DEG * 297 / 420)["y"]
    crop = G.bounds(F.lit(-80.26), F.lit(43.5), F.lit(-80.24), north)
    items = s.sql(HISTORY).select(
        "item_no", "mode", "policy", "provider_id", "license_url", "source_url", "asset_id",
        crop.alias("bounds"), F.lit(43.5).alias("lat"), F.lit(-80.25).alias("lng"),
        F.struct(F.lit("arcgis-export").alias("kind"), c("source_url").alias("url"), c("max_width").alias("max_width"),
                 c("max_width").alias("max_height")).alias("export"),
        F.lit("napl:x").alias("result_id"), G.bounds(-81.0, 43.0, -79.0, 44.0).alias("source_coverage"),
        F.lit("p").alias("placement"))
    from sitesift.plans.catalog_queries import full_providers

    providers = full_providers(s).withColumn("coverage", G.bounds("west", "south", "east", "north"))
    return rules.historical_readiness(items, providers).select("item_no", joined("reasons"))


@query("validate_historical", f"""
WITH h AS ({HISTORY}), n AS (SELECT project_id, year, sequence, COUNT(*) AS n FROM h GROUP BY 1, 2, 3)
SELECT h.item_no, concat_ws(',', CASE WHEN h.item_no % 23 = 0 THEN 'id' END, CASE WHEN h.sequence < 1 THEN 'sequence' END,
  CASE WHEN policy <> 'exportable' THEN 'policy' END, CASE WHEN h.item_no % 29 = 0 THEN 'updated-before-created' END,
  CASE WHEN mode = 'official' THEN 'official-with-asset' END, CASE WHEN mode = 'manual' THEN 'asset' END,
  CASE WHEN n > 1 THEN 'sequence-repeated' END) AS violations
FROM h JOIN n ON n.project_id = h.project_id AND n.year = h.year AND n.sequence = h.sequence
""")
def validate_historical(s: Source) -> DataFrame:
    c = F.col
    uuid = F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(c("item_no").cast("string"), 12, "0"))
    items = s.sql(HISTORY).select(
        "item_no", "project_id", F.when(c("item_no") % 23 == 0, F.concat(F.lit("x"), c("item_no").cast("string"))).otherwise(uuid).alias("id"),
        "mode", "policy", "provider_id", "license_url", "source_url", "asset_id", "year", "sequence",
        F.lit("Title").alias("title"), F.lit("By").alias("attribution"), F.lit(0.5).alias("resolution_m"),
        G.bounds(-80.5, 43.25, -80.0, 43.75).alias("bounds"), F.lit(43.5).alias("lat"), F.lit(-80.25).alias("lng"),
        F.lit("2024-05-01T10:00:00Z").alias("created_at"),
        F.when(c("item_no") % 29 == 0, "2024-05-01T09:59:59.5Z").otherwise("2024-05-01T11:00:00+00:30").alias("updated_at"),
        G.bounds(-81.0, 43.0, -79.0, 44.0).alias("source_coverage"))
    return rules.validate_historical(items, 2026).select("item_no", joined())


@query("validate_annotations", """
WITH a AS (SELECT c_custkey AS project_id, k AS pos, CASE WHEN k = 2 AND c_custkey % 3 = 0 THEN 'a0' ELSE 'a' || k END AS id
  FROM customer, (VALUES (0), (1), (2)) t(k))
SELECT project_id, CAST(pos AS INT) AS pos, concat_ws(',', CASE WHEN project_id % 3 = 0 AND id = 'a0' THEN 'id-repeated' END,
  CASE WHEN pos = 1 AND project_id % 5 = 0 THEN 'figure' END, CASE WHEN pos = 0 AND project_id % 7 = 0 THEN 'text' END,
  CASE WHEN pos = 2 AND project_id % 11 = 0 THEN 'target' END) AS violations FROM a
""")
def validate_annotations(s: Source) -> DataFrame:
    c = F.col
    key = c("c_custkey")

    def note(k: int, ident, figure, text, target):
        return F.struct(
            ident.alias("id"), figure.alias("figure"), text.alias("text"), F.lit(43.5).alias("lat"),
            F.lit(-80.0).alias("lng"), target.alias("target_lat"), F.when(target.isNotNull(), -80.0).alias("target_lng"),
            F.lit(True).alias("mask"))

    none = F.lit(None).cast("double")
    notes = F.array(
        note(0, F.lit("a0"), F.lit("A"), F.when(key % 7 == 0, " ").otherwise("Note"), none),
        note(1, F.lit("a1"), F.when(key % 5 == 0, "F").otherwise("B"), F.lit("Note"), none),
        note(2, F.when(key % 3 == 0, "a0").otherwise("a2"), F.lit("C"), F.lit("Note"),
             F.when(key % 11 == 0, 95.0).otherwise(44.0)))
    given = s.table("customer").select(key.alias("project_id"), notes.alias("annotations"))
    return rules.validate_annotations(given).select("project_id", "pos", joined())


SOURCES = """SELECT s_suppkey AS id, CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE s_name END AS name, 'C' AS credits, 'L' AS license,
  CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE 'E' END AS evidence, CASE WHEN s_suppkey % 3 = 0 THEN 'ftp://x' ELSE 'http://example.org/a' END AS source_url,
  CAST(CASE WHEN s_suppkey % 2 = 0 THEN NULL WHEN s_suppkey % 11 = 0 THEN 1700 ELSE 1990 END AS INT) AS year,
  CASE WHEN s_suppkey % 4 < 2 THEN 'unknown' ELSE 'verified' END AS verification, (s_suppkey % 13 <> 0) AS permission FROM supplier"""


@query("validate_provenance", f"""
SELECT id, concat_ws(',', CASE WHEN id % 5 = 0 THEN 'name' END, CASE WHEN id % 7 = 0 THEN 'evidence' END,
  CASE WHEN id % 3 = 0 THEN 'source-url' END, CASE WHEN year = 1700 THEN 'year' END,
  CASE WHEN year IS NULL AND verification <> 'unknown' THEN 'unknown-year-verified' END,
  CASE WHEN year IS NOT NULL AND verification = 'unknown' THEN 'known-year-unverified' END,
  CASE WHEN NOT permission THEN 'permission' END) AS violations FROM ({SOURCES}) s
""")
def validate_provenance(s: Source) -> DataFrame:
    return rules.validate_provenance(s.sql(SOURCES), 2027).select("id", joined())
