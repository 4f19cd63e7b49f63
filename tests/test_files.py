"""Round trips through files."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from sitesift.operators import links
from sitesift.plans.bindings import Source
from sitesift.plans.site_queries import features
from sitesift.plans.survey_queries import SPOTS, contours
from sitesift.sinks import exports
from sitesift.sources import kml, records

FOLDER = "/root/testdata/sf0.001"
KML = """<?xml version="1.0"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document>
<Style id="a"><PolyStyle><color>800000ff</color></PolyStyle></Style>
<StyleMap id="m"><Pair><key>normal</key><styleUrl>#a</styleUrl></Pair></StyleMap>
<Placemark><name>Custom</name><styleUrl>#m</styleUrl><description><![CDATA[<b>Two</b>  words]]></description>
<Polygon><outerBoundaryIs><LinearRing><coordinates>0,0 10,0,5 10,10 bad 0,10 0,0</coordinates></LinearRing></outerBoundaryIs>
<innerBoundaryIs><LinearRing><coordinates>3,3 7,3 7,7 3,7</coordinates></LinearRing></innerBoundaryIs></Polygon></Placemark>
<Placemark><name>x</name><ExtendedData><Data name="Unit_Code"><value>5b</value></Data></ExtendedData>
<MultiGeometry><Polygon><outerBoundaryIs><LinearRing><coordinates>0,0 1,0 1,1</coordinates></LinearRing></outerBoundaryIs></Polygon>
<Polygon><outerBoundaryIs><LinearRing><coordinates>0,0 1,0</coordinates></LinearRing></outerBoundaryIs></Polygon></MultiGeometry></Placemark>
</Document></kml>"""
OPTIONS = {"image_height": 190, "scale": 1500, "dpi": 300, "start": 1, "description": "A, b"}


def test_kml_and_kmz(spark, tmp_path):
    (tmp_path / "a.kml").write_text(KML)
    with zipfile.ZipFile(tmp_path / "b.kmz", "w") as archive:
        archive.writestr("x.kml", "no")
        archive.writestr("Doc.KML", KML)
    (tmp_path / "broken.kmz").write_bytes(b"nothing")
    rows = kml.read_kml_polygons(spark, str(tmp_path / "a.kml")).orderBy("feature_seq").collect()
    assert [r["name"] for r in rows] == ["Custom", "5B — Till"]
    first = rows[0]
    assert (first["color"], round(first["fill_opacity"], 3), first["description"]) == ("#ff0000", 0.502, "Two words")
    assert len(first["polygon"]) == 5 and len(first["holes"][0]) == 5
    docs = kml.read_kmz(spark, str(tmp_path / "*.kmz"))
    assert docs.where("error IS NOT NULL").count() == 1
    assert kml.kml_features(docs.where("kml IS NOT NULL").select("doc", "kml")).count() == 2


def test_style_chain_with_a_cycle(spark):
    styles = spark.createDataFrame([("d", "s", "#fff", 1.0)], "doc STRING, style_id STRING, color STRING, opacity DOUBLE")
    maps = spark.createDataFrame([("d", "a", "b"), ("d", "b", "c"), ("d", "c", "s"), ("d", "x", "y"), ("d", "y", "x")],
                                 "doc STRING, style_id STRING, target STRING")
    out = {r["style_id"]: r["color"] for r in links.resolve_styles(styles, maps).collect()}
    assert out == {"s": "#fff", "a": "#fff", "b": "#fff", "c": "#fff", "x": None, "y": None}


def read_lines(folder, key):
    parts = sorted((folder / key).glob("part-*"))
    return "".join(p.read_bytes().decode() for p in parts)


def test_drawings_are_whole_documents(spark, tmp_path):
    spots = Source(spark, FOLDER).sql(SPOTS).where("drawing_id < 2").withColumn("raw_full", F.col("raw")).withColumn(
        "status", F.lit("OK"))
    exports.write_spot_csv(spots, OPTIONS, str(tmp_path / "csv"))
    text = read_lines(tmp_path / "csv", "drawing_id=1")
    rows = text.strip().split("\n")
    assert rows[0] == exports.CSV_HEADER and rows[1].startswith("1,") and ",A__b," in rows[1]
    assert [int(r.split(",")[0]) for r in rows[1:]] == list(range(1, len(rows)))
    exports.write_pnezd(spots, OPTIONS, str(tmp_path / "pnezd"))
    assert read_lines(tmp_path / "pnezd", "drawing_id=0").count("\r\n") == spots.where("drawing_id = 0 AND include").count()
    exports.write_landxml(spots, OPTIONS, str(tmp_path / "xml"), "2024-01-01")
    assert read_lines(tmp_path / "xml", "drawing_id=0").rstrip().endswith("</LandXML>")
    exports.write_dxf_points(spots, OPTIONS, str(tmp_path / "dxf"), "block")
    drawing = read_lines(tmp_path / "dxf", "drawing_id=0")
    assert drawing.startswith("0\nSECTION\n2\nHEADER") and drawing.endswith("0\nENDSEC\n0\nEOF\n")
    exports.write_dxf_polylines(contours(Source(spark, FOLDER)).where("drawing_id = 1"), str(tmp_path / "lines"))
    assert "POLYLINE" in read_lines(tmp_path / "lines", "drawing_id=1")


def test_feature_tiles(spark, tmp_path):
    given = features(Source(spark, FOLDER))
    n = given.count()
    manifest = exports.write_feature_tiles(given, str(tmp_path / "t"), n)
    assert manifest.agg(F.sum("feature_count")).first()[0] == n
    assert exports.newest_status(spark, str(tmp_path / "t"))["complete"]
    exports.write_feature_tiles(given, str(tmp_path / "t2"), n + 1)
    assert not exports.newest_status(spark, str(tmp_path / "t2"))["complete"]
    with pytest.raises(ValueError, match="incomplete"):
        exports.read_feature_tiles(spark, str(tmp_path / "t2"))
    some = exports.read_feature_tiles(spark, str(tmp_path / "t"), {"west": -90.0, "south": 43.0, "east": -89.0, "north": 44.0})
    assert 0 < some.count() < n
    # A rewrite that fails half-way leaves no promise of the version before.
    broken = given.withColumn("west", F.when(F.col("feature_seq") > 5, F.raise_error(F.lit("broken"))).otherwise(F.col("west")))
    with pytest.raises(Exception, match="broken"):
        exports.write_feature_tiles(broken, str(tmp_path / "t"), n)
    with pytest.raises(ValueError, match="incomplete"):
        exports.read_feature_tiles(spark, str(tmp_path / "t"))


def test_projects_and_world_files(spark, tmp_path):
    saved = {"schema_version": 2, "name": "p", "figures": {"B": {"title": "t", "extent_m": 250}},
             "selection": [{"kind": "figure", "key": "C"}, {"kind": "historical", "key": "gone"}]}
    (tmp_path / "p.json").write_text(json.dumps(saved) + "\nnot json\n")
    rows = {r["name"]: r for r in records.read_projects(spark, str(tmp_path / "p.json")).collect()}
    assert rows["p"]["figures"]["B"]["extent_m"] == 100.0 and len(rows["p"]["figures"]) == 5
    assert [s["key"] for s in rows["p"]["selection"]] == ["C"] and rows[None]["_corrupt_record"] == "not json"
    (tmp_path / "w.pgw").write_text("1\r\n0\r\n0\r\n-2\r\n500000.5\r\n4800099\r\n\r\n")
    (tmp_path / "v.pgw").write_text("1\n0\n\n0\n-2\n5\n6")
    out = {r["path"][-5:]: r for r in records.read_world_files(spark, str(tmp_path / "*.pgw")).collect()}
    assert out["w.pgw"]["coeffs"] == [1.0, 0.0, 0.0, -2.0, 500000.5, 4800099.0]
    assert out["v.pgw"]["error"] == "six-decimals"


def test_manifest_and_world_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "b.txt", 3), (1, "a.txt", 2)], "package_id INT, path STRING, bytes INT")
    exports.write_manifest(rows, str(tmp_path / "m"))
    assert read_lines(tmp_path / "m" / "csv", "package_id=1") == "path,bytes\r\na.txt,2\r\nb.txt,3\r\n"
    assert read_lines(tmp_path / "m" / "json", "package_id=1").split("\n")[0] == '{"bytes":2,"path":"a.txt"}'
    frames = spark.createDataFrame([("i", [1.0, 0.0, 0.0, -2.0, 500000.5, 4800099.0])], "image_id STRING, coeffs ARRAY<DOUBLE>")
    exports.write_world_files(frames, str(tmp_path / "w"))
    assert read_lines(tmp_path / "w", "image_id=i") == (
        "1.00000000000\n0.00000000000\n0.00000000000\n-2.00000000000\n500000.500000\n4800099.00000\n")


def test_a_viewport_reads_only_its_tiles(spark, tmp_path):
    from sitesift.functions import geometry as G

    p = lambda x, y: G.point(F.col("west") + x, F.col("south") + y)
    df = spark.range(400).select(F.col("id").alias("feature_seq"), F.lit("surficial").alias("dataset_id"), (F.col("id") % 20 * 1.0).alias("west"),
                                 (F.col("id") / 20).cast("int").cast("double").alias("south"))
    df = df.withColumn("polygon", F.array(p(0, 0), p(0.5, 0), p(0.5, 0.5), p(0, 0))).withColumn("holes", F.array().cast("array<array<struct<x:double,y:double>>>"))
    df = df.withColumn("east", F.col("west") + 0.5).withColumn("north", F.col("south") + 0.5)
    path = str(tmp_path / "tiles")
    exports.write_feature_tiles(df, path, 400)
    read = {}
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # so that the plan shows its scans
    for name, side in (("small", 1.0), ("large", 8.0)):
        view = {"west": 3.1, "south": 3.1, "east": 3.1 + side, "north": 3.1 + side}
        found = exports.read_feature_tiles(spark, path, view)
        assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString()
        want = df.where(f"west <= {3.1 + side} AND east >= 3.1 AND south <= {3.1 + side} AND north >= 3.1")
        assert sorted(r.feature_seq for r in found.collect()) == sorted(r.feature_seq for r in want.collect())
        leaves = found._jdf.queryExecution().executedPlan().collectLeaves()
        scans = [leaves.apply(i) for i in range(leaves.size()) if leaves.apply(i).metrics().contains("filesSize")]
        read[name] = max(int(s.metrics().get("filesSize").get().value()) for s in scans)
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    whole = sum(f.stat().st_size for f in (tmp_path / "tiles").rglob("features/**/*.parquet"))
    assert 0 < read["small"] < read["large"] < whole
    # a tile outside the viewport may be broken, one inside may not
    gone = next((tmp_path / "tiles").rglob("features/dataset_id=surficial/tile=12_12/*.parquet"))
    gone.unlink()
    view = {"west": 3.1, "south": 3.1, "east": 3.9, "north": 3.9}
    assert exports.read_feature_tiles(spark, path, view).count() == 1
    with pytest.raises(ValueError):
        exports.read_feature_tiles(spark, path, view | {"east": 14.0, "north": 14.0})
    exports.publish_status(spark, path, "next", 1, 0, False)
    with pytest.raises(ValueError):
        exports.read_feature_tiles(spark, path, view)


def test_archives_are_unpacked_a_few_at_a_time(spark, monkeypatch):
    """Before, all archives of a batch were held unpacked until the last was done."""
    import io
    import zipfile

    import pyarrow as pa

    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as archive:
        archive.writestr("doc.kml", "x")
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array([buffer.getvalue()] * 999 + [b"no"])], ["doc", "content"])
    files = spark.createDataFrame([], "doc BIGINT, content BINARY")
    taken = []
    monkeypatch.setattr(type(files), "mapInArrow", lambda self, run, schema: taken.append(run), raising=False)
    kml.kmz_documents(files)
    out = list(taken[0](iter([batch])))
    assert max(part.num_rows for part in out) <= 64
    rows = [row for part in out for row in part.to_pylist()]
    assert [r["doc"] for r in rows] == list(range(1000)) and {r["kml"] for r in rows[:-1]} == {"x"}
    assert rows[-1]["kml"] is None and rows[-1]["error"]
