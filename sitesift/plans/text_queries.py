"""Queries over codes, cells, descriptions and embedded texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitesift.functions import text as X
from sitesift.plans.bindings import Source
from sitesift.plans.registry import query, scalar
from sitesift.plans.site_queries import code_sql

LABELS = """SELECT feature_seq, label, CONCAT(CASE feature_seq % 5 WHEN 0 THEN 'G12a' WHEN 1 THEN '54' WHEN 2 THEN '7B'
  WHEN 3 THEN 'unit 7' ELSE '123' END, CASE WHEN feature_seq % 2 = 0 THEN ' rock' ELSE '' END) AS bedrock,
  CASE feature_seq % 4 WHEN 0 THEN '#8033CCff' WHEN 1 THEN 'ff0000FF' WHEN 2 THEN 'xyz' ELSE ' 7f00ff00 ' END AS kml,
  CASE feature_seq % 6 WHEN 0 THEN CONCAT('=', label) WHEN 1 THEN CONCAT(label, ', "x"') WHEN 2 THEN ' -1' WHEN 3 THEN CONCAT('<', label, '> & ''y''')
    WHEN 4 THEN CONCAT(label, '  two ,', label) ELSE '' END AS cell FROM b_features"""
KEY = ["feature_seq"]

scalar("surficial_code", LABELS, KEY, lambda: {"code": X.surficial_code("label")}, {"code": code_sql("label")})
scalar("bedrock_code", LABELS, KEY, lambda: {"code": X.bedrock_code("bedrock")},
       {"code": "CASE feature_seq % 5 WHEN 0 THEN 'g12a' WHEN 1 THEN '54' WHEN 2 THEN '7b' END"})
scalar("kml_color", LABELS, KEY,
       lambda: {"color": X.kml_color("kml")["color"], "opacity": F.round(X.kml_color("kml")["opacity"], 9)},
       {"color": "CASE feature_seq % 4 WHEN 0 THEN '#ffcc33' WHEN 1 THEN '#ff0000' WHEN 3 THEN '#00ff00' END",
        "opacity": "CASE feature_seq % 4 WHEN 0 THEN ROUND(128 / 255e0, 9) WHEN 1 THEN 1e0 WHEN 3 THEN ROUND(127 / 255e0, 9) END"})
scalar("csv_cell", LABELS, KEY, lambda: {"out": X.csv_cell("cell")},
       {"out": "CASE feature_seq % 6 WHEN 0 THEN '''' || cell WHEN 1 THEN '\"' || replace(cell, '\"', '\"\"') || '\"' "
               "WHEN 2 THEN '''' || cell WHEN 4 THEN '\"' || cell || '\"' ELSE cell END"})
scalar("xml_escape", LABELS, KEY, lambda: {"out": X.xml_escape("cell")},
       {"out": "replace(replace(replace(replace(replace(cell, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')"})
scalar("clean_description", LABELS, KEY, lambda: {"out": X.clean_description("cell")},
       {"out": "CASE WHEN trim(cell) = '' THEN 'SPOT_ELEV' ELSE regexp_replace(regexp_replace(trim(cell), '[,\\r\\n]+', '_', 'g'), '\\s+', '_', 'g') END"})
scalar("slug", LABELS, KEY, lambda: {"out": X.slug("cell")},
       {"out": "COALESCE(NULLIF(regexp_replace(regexp_replace(cell, '[^A-Za-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'Image')"})
scalar("slug_full", LABELS, KEY, lambda: {"out": X.slug_full("cell")},
       {"out": "COALESCE(NULLIF(regexp_replace(regexp_replace(cell, '[^A-Za-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'Image')"})
scalar("legend_label", LABELS, KEY,
       lambda: {f: X.legend_label(X.surficial_code("label"), "label", F.when(
           F.col("feature_seq") % 2 == 0, "Glacial till"))[f] for f in ("code", "title", "heading")},
       {"code": f"COALESCE(upper({code_sql('label')}), '')",
        "title": f"CASE WHEN feature_seq % 2 = 0 THEN 'GLACIAL TILL' WHEN {code_sql('label')} IS NULL THEN label "
                 f"WHEN length(label) > length({code_sql('label')}) THEN trim(substr(label, length({code_sql('label')}) + 2)) ELSE label END",
        "heading": f"concat_ws(' ', upper({code_sql('label')}), CASE WHEN feature_seq % 2 = 0 THEN 'GLACIAL TILL' WHEN {code_sql('label')} IS NULL THEN label "
                   f"WHEN length(label) > length({code_sql('label')}) THEN trim(substr(label, length({code_sql('label')}) + 2)) ELSE label END)"})

DATES = """SELECT event_id, CASE event_id % 4 WHEN 0 THEN '2024-02-30' WHEN 1 THEN CAST(CAST(ts AS DATE) AS STRING) WHEN 2 THEN '2024-2-3' ELSE NULL END AS d,
  CASE event_id % 5 WHEN 0 THEN CONCAT(CAST(CAST(ts AS DATE) AS STRING), 'T10:00:00Z') WHEN 1 THEN '2024-01-01T25:00:00Z'
    WHEN 2 THEN '2024-01-01T10:00:00.123-05:00' WHEN 3 THEN '2024-01-01 10:00:00' ELSE NULL END AS t,
  CAST(1840 + event_id % 200 AS INT) AS y FROM events"""
scalar("valid_year", DATES, ["event_id"], lambda: {"ok": X.valid_year("y", 2026)}, {"ok": "(y BETWEEN 1850 AND 2026)"})
scalar("valid_date", DATES, ["event_id"], lambda: {"ok": X.valid_date("d")}, {"ok": "(event_id % 4 = 1)"})
scalar("valid_timestamp", DATES, ["event_id"], lambda: {"ok": X.valid_timestamp("t")}, {"ok": "(event_id % 5 IN (0, 2))"})


def strip_sql(column: str) -> str:
    out = column
    for pattern in ("<head\\b.*?</head>", "<script\\b.*?</script>", "<style\\b.*?</style>", "<!--.*?-->", "<[^>]*>"):
        out = f"regexp_replace({out}, '{pattern}', '', 'gis')"
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        out = f"replace({out}, '{entity}', '{char}')"
    return f"trim(regexp_replace({out}, '[\\s\\x{{00A0}}]+', ' ', 'g'))"


@query("strip_html", f"SELECT page_id, {strip_sql('html')} AS text FROM pages")
def strip_html(s: Source) -> DataFrame:
    return s.table("pages").select("page_id", X.strip_html("html").alias("text"))


@query("dxf_escape", """
WITH t AS (SELECT item_id, i, CASE WHEN ch IN ('\\', '{', '}', '%', '^', '~') OR ascii(ch) > 126 THEN 7 WHEN ch = chr(10) THEN 2 ELSE 1 END AS n
  FROM (SELECT item_id, unnest(range(1, length(text) + 1)) AS i, substr(text, CAST(unnest(range(1, length(text) + 1)) AS INT), 1) AS ch FROM benchmark) q)
SELECT item_id, CAST(SUM(n) AS INT) AS total FROM t GROUP BY 1
""")
def dxf_escape(s: Source) -> DataFrame:
    chunks = X.dxf_escape("text")
    total = F.aggregate(chunks, F.lit(0), lambda acc, c: acc + F.length(c))
    return s.table("benchmark").select("item_id", total.alias("total"))


@query("stable_json", """
SELECT feature_seq, '{"holes":' || CASE WHEN has_hole THEN 'true' ELSE 'false' END || ',"label":"' || label || '","none":null,"seq":' || feature_seq
  || ',"xs":[' || CAST(feature_seq % 3 AS BIGINT) || ',0.5]}' AS json FROM b_features
""")
def stable_json(s: Source) -> DataFrame:
    row = F.struct(
        F.col("feature_seq").alias("seq"), "label", F.col("has_hole").alias("holes"),
        F.array((F.col("feature_seq") % 3).cast("double"), F.lit(0.5)).alias("xs"),
        F.lit(None).cast("string").alias("none"))
    made = s.view("b_features").select("feature_seq", row.alias("row"))
    kind = made.schema["row"].dataType
    return made.select("feature_seq", X.stable_json("row", kind).alias("json"))


@query("decode_data_url", """
SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN 'image/png' END AS mime,
  CASE WHEN doc_id % 5 <> 0 THEN CAST(strlen(text) AS INT) END AS bytes FROM documents
""")
def decode_data_url(s: Source) -> DataFrame:
    coded = F.regexp_replace(F.base64(F.encode("text", "utf-8")), r"\s", "")
    url = F.concat(F.when(F.col("doc_id") % 5 == 0, "data:text/png;base64,").otherwise(
        "data:image/PNG;base64,"), coded)
    d = X.decode_data_url("url")
    return s.table("documents").select("doc_id", url.alias("url")).select(
        "doc_id", d["mime"].alias("mime"), F.octet_length(d["bytes"]).alias("bytes"))
