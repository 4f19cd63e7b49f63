"""Views that derive coordinates, labels and records from the base tables.

The text of ``VIEWS`` runs unchanged in Spark and in the checking database;
``cte`` puts the needed ones, with what they build on, in front of a query.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

VIEWS = {
    "b_sites": """
SELECT c_custkey AS site_id,
  -94.96875e0 + ((c_custkey * 37) % 320) / 16e0 AS lng,
  42.03125e0 + ((c_custkey * 53) % 112) / 16e0 AS lat,
  CAST(1930 + c_custkey % 90 AS INT) AS requested_year
FROM customer
""",
    "b_features": """
SELECT p_partkey AS feature_seq,
  -95e0 + ((p_partkey * 29) % 304) / 16e0 AS west,
  42e0 + ((p_partkey * 31) % 96) / 16e0 AS south,
  -95e0 + ((p_partkey * 29) % 304) / 16e0 + (3 + p_size % 15) / 16e0 AS east,
  42e0 + ((p_partkey * 31) % 96) / 16e0 + (3 + (p_size * 7) % 11) / 16e0 AS north,
  (p_partkey % 3 = 0 AND p_size % 15 >= 3 AND (p_size * 7) % 11 >= 3) AS has_hole,
  CASE p_partkey % 12 WHEN 0 THEN '9c deposits' WHEN 1 THEN '5b till' WHEN 2 THEN '19' WHEN 3 THEN '12'
    WHEN 4 THEN '8a' WHEN 5 THEN '21 fill' WHEN 6 THEN '20' WHEN 7 THEN '3' WHEN 8 THEN '16b'
    WHEN 9 THEN '99 unknown' WHEN 10 THEN 'Custom A' ELSE '7b gravel' END AS label
FROM part
""",
    "b_edges": """
SELECT feature_seq, 0 AS ring_no, 1 AS edge_no, west AS x1, south AS y1, east AS x2, south AS y2 FROM b_features
UNION ALL SELECT feature_seq, 0, 2, east, south, east, north - 0.125e0 FROM b_features
UNION ALL SELECT feature_seq, 0, 3, east, north - 0.125e0, east - 0.125e0, north FROM b_features
UNION ALL SELECT feature_seq, 0, 4, east - 0.125e0, north, west, north FROM b_features
UNION ALL SELECT feature_seq, 0, 5, west, north, west, south FROM b_features
UNION ALL SELECT feature_seq, 1, 1, west + 0.125e0, south + 0.125e0, east - 0.125e0, south + 0.125e0 FROM b_features WHERE has_hole
UNION ALL SELECT feature_seq, 1, 2, east - 0.125e0, south + 0.125e0, east - 0.125e0, north - 0.125e0 FROM b_features WHERE has_hole
UNION ALL SELECT feature_seq, 1, 3, east - 0.125e0, north - 0.125e0, west + 0.125e0, north - 0.125e0 FROM b_features WHERE has_hole
UNION ALL SELECT feature_seq, 1, 4, west + 0.125e0, north - 0.125e0, west + 0.125e0, south + 0.125e0 FROM b_features WHERE has_hole
""",
    "b_providers": """
SELECT * FROM (VALUES (0,'napl',5,'exportable'),(1,'ontario',10,'exportable'),(2,'toronto',20,'exportable'),
  (3,'ottawa',30,'unknown'),(4,'esri-wayback',35,'link-only')) AS t(provider_no, provider_id, priority, policy)
""",
    "b_catalog": """
SELECT CONCAT(p.provider_id, ':', CAST(s.s_suppkey AS STRING), '-', CAST(k.k AS STRING)) AS id, p.provider_id, p.priority,
  CAST(1930 + (s.s_suppkey * 7 + k.k * 11) % 95 AS INT) AS year,
  CASE WHEN (s.s_suppkey + k.k) % 4 = 0 THEN NULL ELSE (1 + (s.s_suppkey * k.k) % 8) / 8e0 END AS resolution_m,
  CASE WHEN p.policy <> 'exportable' THEN p.policy WHEN s.s_suppkey % 3 = 0 THEN 'unknown'
    WHEN (s.s_suppkey + k.k) % 5 = 0 THEN 'link-only' ELSE 'exportable' END AS policy,
  -95e0 + ((s.s_suppkey * 17) % 240) / 16e0 AS west, 42e0 + ((s.s_suppkey * 19) % 64) / 16e0 AS south,
  -95e0 + ((s.s_suppkey * 17) % 240) / 16e0 + (32 + s.s_suppkey % 64) / 16e0 AS east,
  42e0 + ((s.s_suppkey * 19) % 64) / 16e0 + (24 + s.s_suppkey % 48) / 16e0 AS north
FROM supplier s CROSS JOIN (VALUES (0),(1),(2),(3),(4),(5),(6),(7)) AS k(k)
JOIN b_providers p ON p.provider_no = s.s_nationkey % 5
""",
    "b_tokens": """
SELECT l_orderkey % 400 AS drawing_id, (l_partkey * 13) % 260 AS x, (l_suppkey * 97 + l_linenumber * 41) % 190 AS y,
  100 + CAST(l_quantity AS INT) AS whole, CAST(ROUND(ABS(l_discount) * 100) AS INT) AS cents,
  CASE l_returnflag WHEN 'A' THEN 0.95e0 WHEN 'N' THEN 0.58e0 ELSE 0.25e0 END AS confidence, COUNT(*) AS copies
FROM lineitem GROUP BY 1, 2, 3, 4, 5, 6
""",
    "b_contours": """
SELECT o_orderkey AS contour_id, o_custkey % 60 AS drawing_id,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'CONTOUR_MAJOR' WHEN '2-HIGH' THEN 'BUILDING_Z0' ELSE 'CONTOUR' END AS layer,
  ((o_orderkey * 7) % 512) / 4e0 AS x1, 0e0 AS y1, ((o_orderkey * 7) % 512) / 4e0 + (o_orderkey % 5 - 2) / 2e0 AS x2, 64e0 AS y2,
  ((o_orderkey * 7) % 512) / 4e0 + (o_orderkey % 3 - 1) / 1e0 AS x3, 64e0 + (o_orderkey % 9) * 8e0 AS y3
FROM orders
""",
    "b_links": """
SELECT s_suppkey AS doc_id, CASE WHEN s_suppkey = 0 THEN NULL ELSE CAST(FLOOR((s_suppkey - 1) / 3e0) AS BIGINT) END AS parent_id FROM supplier
""",
}


def needed(sql: str) -> list[str]:
    """Names of the views that ``sql`` uses, dependencies first."""
    found: list[str] = []
    for name in VIEWS:
        if re.search(rf"\b{name}\b", sql):
            for inner in needed(VIEWS[name]):
                if inner not in found:
                    found.append(inner)
            if name not in found:
                found.append(name)
    return found


def cte(sql: str) -> str:
    """``sql`` with the views it uses as leading common table expressions."""
    body = sql.strip()
    views = ",\n".join(f"{name} AS ({VIEWS[name].strip()})" for name in needed(sql))
    if not views:
        return body
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {views},\n{body[len('WITH RECURSIVE'):]}"
    if body.upper().startswith("WITH"):
        return f"WITH {views},\n{body[len('WITH'):]}"
    return f"WITH {views}\n{body}"


class Source:
    """The base tables of one folder, with the views above on top."""

    _registered: tuple[SparkSession, str] | None = None

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        done = Source._registered
        if done is None or done[0] is not spark or done[1] != folder:
            for name in TABLES:
                self.table(name).createOrReplaceTempView(name)
            for name, text in VIEWS.items():
                spark.sql(text).createOrReplaceTempView(name)
            Source._registered = (spark, folder)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        return self.spark.table(name)

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(text)
