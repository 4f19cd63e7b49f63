"""Project records: migration, counters, ordering and selections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitesift.operators.numbering import id_block, number_rows, running_sum

# Figure codes with their default titles and spans, saved version.
FIGURES = {
    "A": ("SITE LOCATION MAP", 500.0), "B": ("CURRENT AERIAL / SITE PLAN", 100.0),
    "C": ("TOPOGRAPHICAL MAP", 1000.0), "D": ("SURFICIAL GEOLOGY", 2000.0),
    "E": ("BEDROCK GEOLOGY", 20000.0),
}
SCHEMA_VERSION = 6


def sequence_counters(items: DataFrame, saved: DataFrame) -> DataFrame:
    """(project_id, year, counter): the larger of the saved counter and the items' sequences."""
    both = saved.select("project_id", "year", F.col("counter").alias("_v")).unionByName(
        items.select("project_id", "year", F.col("sequence").alias("_v")))
    return both.groupBy("project_id", "year").agg(F.max("_v").alias("counter"))


def next_sequence(new_items: DataFrame, counters: DataFrame, item: str = "item_id") -> DataFrame:
    """``new_items`` with the sequence each gets: numbers go on from the counter."""
    numbered = number_rows(
        new_items, ["project_id", "year"], [id_block(item)], [F.col(item)], "_n")
    return numbered.join(counters, ["project_id", "year"], "left").withColumn(
        "sequence", F.coalesce("counter", F.lit(0)).cast("bigint") + F.col("_n")
    ).drop("counter", "_n")


def sheet_order(selection: DataFrame, group: str = "package_id") -> DataFrame:
    """Figures A to E first, then historical sheets by year, sequence and code."""
    year = F.regexp_extract("code", r"^H-(\d{4})-(\d+)$", 1)
    number = F.regexp_extract("code", r"^H-(\d{4})-(\d+)$", 2)
    ranked = selection.withColumn("_kind", F.when(F.col("code").isin(*FIGURES), 0).otherwise(1))
    ranked = ranked.withColumn("_year", F.coalesce(
        F.nullif(year, F.lit("")).cast("int"), F.lit(0))).withColumn(
        "_seq", F.coalesce(F.nullif(number, F.lit("")).cast("bigint"), F.lit(0).cast("bigint")))
    order = [F.col("_kind"), F.col("_year"), F.col("_seq"), F.col("code")]
    placed = number_rows(
        ranked, [group], [F.col("_kind"), F.col("_year"), id_block("_seq")], order, "pos")
    return placed.drop("_kind", "_year", "_seq")


def sheet_pages(ordered: DataFrame, group: str = "package_id", continuations: str = "continuations") -> DataFrame:
    """``ordered`` (of ``sheet_order``, with the number of continuation pages of each sheet) with first_page and last_page.

    Pages run through a package from 1; a sheet takes one page and its continuations. A missing number counts as none.
    """
    weighed = ordered.withColumn("_pages", F.greatest(F.coalesce(F.col(continuations), F.lit(0)), F.lit(0)).cast("bigint") + 1)
    ended = running_sum(weighed, [group], [id_block("pos")], [F.col("pos")], "_pages", "last_page")
    return ended.withColumn("first_page", F.col("last_page") - F.col("_pages") + 1).drop("_pages")


def selection_intersect(saved: DataFrame, ready: DataFrame, *keys: str) -> DataFrame:
    """Saved selections that are ready."""
    return saved.join(ready.select(*keys), list(keys), "left_semi")


def unknown_selection(saved: DataFrame, known: DataFrame, *keys: str) -> DataFrame:
    """Saved selections that name nothing known."""
    return saved.join(known.select(*keys), list(keys), "left_anti")


def migrate_projects(projects: DataFrame) -> DataFrame:
    """Bring saved projects to version 6.

    Columns: schema_version, name, figures MAP<code, STRUCT<title, extent_m>>,
    geology MAP<kind, STRUCT<name, source_id, source_name>>, historical
    ARRAY<STRUCT<id, year, sequence>>, selection ARRAY<STRUCT<kind, key>>.
    Missing figures get defaults; figure B's old span of 250 becomes 100 before
    version 3; bare KML names become custom sources; unknown selections go and
    the rest is put in figure, then year and sequence order.
    """
    c = F.col
    old = c("schema_version").isNull() | (c("schema_version") < 3)
    figures = []
    for code, (title, extent) in FIGURES.items():
        saved = F.try_element_at("figures", F.lit(code))
        span = F.coalesce(saved["extent_m"], F.lit(extent))
        if code == "B":
            span = F.when(old & (span == 250), F.lit(100.0)).otherwise(span)
        figures += [F.lit(code), F.struct(
            F.coalesce(saved["title"], F.lit(title)).alias("title"), span.alias("extent_m"))]
    bare = lambda v: v["source_id"].isNull() & v["name"].rlike(r"(?i)\.km[zl]$")
    geology = F.transform_values("geology", lambda _, v: F.struct(
        v["name"].alias("name"),
        F.when(bare(v), "custom").otherwise(v["source_id"]).alias("source_id"),
        F.when(bare(v), F.concat(F.lit("Custom import: "), v["name"]))
        .otherwise(v["source_name"]).alias("source_name")))
    chosen = F.transform("selection", lambda s: F.struct(s["kind"], s["key"]))
    pages = F.filter(
        F.array(*[F.struct(F.lit("figure").alias("kind"), F.lit(k).alias("key")) for k in FIGURES]),
        lambda f: F.exists(chosen, lambda s: (s["kind"] == "figure") & (s["key"] == f["key"])))
    ordered = F.array_sort(F.transform(
        "historical", lambda h: F.struct(h["year"], h["sequence"], h["id"].alias("id"))))
    kept = F.filter(ordered, lambda h: F.exists(
        chosen, lambda s: (s["kind"] == "historical") & (s["key"] == h["id"])))
    sheets = F.transform(kept, lambda h: F.struct(
        F.lit("historical").alias("kind"), h["id"].alias("key")))
    return (
        projects.withColumn("figures", F.create_map(*figures))
        .withColumn("geology", geology).withColumn("selection", F.concat(pages, sheets))
        .withColumn("schema_version", F.lit(SCHEMA_VERSION)))
