"""Saved projects as whole records: what is odd, what is unknown, and the way back."""

import json

from sitesift.operators import rules, saved_projects

SQUARE = [[-80.5, 43.25], [-80.0, 43.25], [-80.0, 43.75], [-80.5, 43.25]]
WHOLE = {
    "schemaVersion": 6, "id": "p", "name": "N", "projectNo": "1", "date": "2024-01-01", "address": "A", "company": "C",
    "location": {"lat": 43.5, "lng": -80.25}, "siteBoundary": SQUARE, "buildingBoundary": [],
    "annotations": [{"id": "n", "figureCode": "B", "text": "t", "position": {"lat": 1.0, "lng": 2.0}, "target": {"lat": 3.0, "lng": 4.0}, "mask": True}],
    "historical": [
        {"id": "h2", "year": 1970, "sequence": 2, "title": "T", "mode": "manual", "attribution": "x", "policy": "exportable", "assetId": "a",
         "placement": {"center": [1.0, 2.0], "groundWidth": 3.0, "groundHeight": 4.0, "sourceWidth": 5.0, "sourceHeight": 6.0, "rotationDegrees": 7.5}},
        {"id": "h1", "year": 1970, "sequence": 1, "officialExport": {"kind": "k", "url": "u", "maxWidth": 1, "maxHeight": 2, "resultId": "r:1", "preview": {
            "kind": "p", "url": "v", "layer": "0", "tileTemplate": "{z}"}}}],
    "historicalSequenceCounters": {"1970": 5, "1999": 1}, "dpi": 150,
    "geology": {"bedrock": {"name": "b", "source": {"id": "custom", "name": "S", "credits": "c", "acquisitionYear": 2011,
                                                    "acquisitionYearVerification": "verified", "permissionConfirmed": True}, "docs": [1, {"q": None}]}},
    "figures": {"A": {"title": "Own", "extentMeters": 7.5, "status": "Done", "bounds": {"north": 44.0, "south": 43.0, "east": -80.0, "west": -81.0},
                      "note": {"deep": [1, 2]}}},
    "exportPreferences": {"codes": [], "selection": [{"kind": "historical", "id": "h2"}, {"kind": "figure", "code": "E"}, {"kind": "historical", "id": "h1"}]},
    "companyProfileSnapshot": {"companyName": "Ltd", "logoWidth": 4.0, "logoPlacement": {"align": "left", "scale": 1.0}},
    "createdAt": "2024-01-01T00:00:00Z", "updatedAt": "2024-01-02T00:00:00Z", "mood": "good", "tags": [1, "two", {"three": 3}]}


def restored(spark, *docs):
    rows = [(i, d if d is None or isinstance(d, str) else json.dumps(d)) for i, d in enumerate(docs)]
    return saved_projects.restore_projects(spark.createDataFrame(rows, "project_id bigint, json string"))


def test_nothing_is_lost(spark):
    back = json.loads(saved_projects.project_json(restored(spark, WHOLE)).first().json)
    for key, value in WHOLE.items():
        if key not in ("figures", "geology", "exportPreferences", "buildingBoundary"):
            assert back[key] == value, key
    assert back["figures"]["A"] == WHOLE["figures"]["A"] and set(back["figures"]) == set("ABCDE")
    bedrock = back["geology"]["bedrock"]
    assert bedrock["docs"] == [1, {"q": None}] and bedrock["source"].items() >= WHOLE["geology"]["bedrock"]["source"].items()
    assert [s.get("code", s.get("id")) for s in back["exportPreferences"]["selection"]] == ["E", "h1", "h2"]
    assert back["exportPreferences"]["codes"] == ["E"]


def test_odd_documents(spark):
    odd = [None, "", "{", "[]", "3", "{}", {"figures": [], "name": None}, {"figures": {"A": {"extentMeters": -1}, "B": {"extentMeters": "x"}}},
           {"figures": {}, "location": {"lat": "x"}, "annotations": {}, "historical": 4, "siteBoundary": "none"},
           {"figures": {}, "historicalSequenceCounters": {"72": 1}}, {"figures": {}, "historicalSequenceCounters": {"1972": -1}},
           {"figures": {}, "historical": [None, {"id": "x"}, {"year": 1970, "sequence": 1}], "annotations": [None]},
           {"figures": {}, "exportPreferences": {"codes": ["B", "Q", "A"]}}, {"figures": {"C": {"bounds": {"north": 1, "south": 2, "east": 1, "west": 0}}}}]
    rows = restored(spark, *odd).orderBy("project_id").collect()
    assert [list(r.violations) for r in rows] == [
        ["document"], ["document"], ["document"], ["document"], ["document"], ["figures"], ["figures", "text-fields"], ["figure-settings"],
        ["location", "site-boundary", "annotations", "historical"], ["counters"], ["counters"], [], [], ["figure-bounds"]]
    assert all(len(r.figures) == 5 and r.schema_version == 6 for r in rows)
    assert [s.key for s in rows[12].selection] == ["A", "B"] and rows[11].historical_counters == {"1970": 1}
    for made in (saved_projects.print_rows, saved_projects.note_rows, saved_projects.item_rows, saved_projects.counter_rows, saved_projects.project_json):
        made(restored(spark, *odd)).collect()


def test_rules_run_on_read_projects(spark):
    found = restored(spark, WHOLE)
    sheet = rules.print_requirements(saved_projects.print_rows(found)).where("figure = 'B'").first()
    assert not {"project-name", "project-number", "project-date", "address", "location", "site-boundary"} & set(sheet.violations)
    assert [list(r.violations) for r in rules.validate_annotations(saved_projects.note_rows(found)).collect()] == [[]]
    items = rules.validate_historical(saved_projects.item_rows(found), 2026)
    assert {r.id for r in items.collect()} == {"h1", "h2"} and all("id" in r.violations for r in items.collect())


def test_files(spark, tmp_path):
    for name, text in (("a.json", json.dumps(WHOLE, indent=2)), ("b.json", "broken")):
        (tmp_path / name).write_text(text)
    rows = {r.project_id.rsplit("/", 1)[1]: r for r in saved_projects.read_saved_projects(spark, str(tmp_path)).collect()}
    assert rows["a.json"].name == "N" and list(rows["b.json"].violations) == ["document"]
