"""Link graphs: style chains and linked documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitesift.functions import geometry as G
from sitesift.functions import text as X
from sitesift.session import durable

# The publisher's host and folder, whose documents a cache keeps under polygons/.
OFFICIAL_HOST = r"(?i)^https?://([^/?#:]*\.)?geologyontario\."
OFFICIAL_FOLDER = "/mines/data/google/mrd128/polygons/"
#: Levels of a walk in one plan, and checkpoints of a walk that are read side by side before they become one.
LEVELS, PIECES = 4, 8


def together(seen: DataFrame, new: DataFrame, times: int) -> DataFrame:
    """Both, as they lie in their checkpoints; every PIECES times they are laid into one."""
    both = seen.unionByName(new)
    return both if times % PIECES else durable(both.repartition("root_id", "doc"))


def resolve_styles(styles: DataFrame, style_maps: DataFrame) -> DataFrame:
    """(doc, style_id, color, opacity) of styles and of the maps that lead to one.

    ``style_maps`` (doc, style_id, target) may chain. Each round doubles the
    reach of every pointer, and a chain has no more maps than there are; what
    still points at a map after log2 of that many rounds is on or behind a cycle and stays
    unresolved. A style hides a map of the same id.
    """
    pointers = durable(style_maps.join(styles, ["doc", "style_id"], "left_anti").select(
        "doc", "style_id", "target"))
    for _ in range(pointers.count().bit_length()):
        hop = pointers.select("doc", F.col("style_id").alias("target"), F.col("target").alias("_to"))
        moved = pointers.join(hop, ["doc", "target"], "left")
        following = durable(moved.select(
            "doc", "style_id", F.coalesce("_to", "target").alias("target"),
            F.col("_to").isNotNull().alias("_moved")))
        pointers = following.select("doc", "style_id", "target")
        if following.where("_moved").isEmpty():
            break
    ends = styles.select("doc", F.col("style_id").alias("target"), "color", "opacity")
    resolved = pointers.join(ends, ["doc", "target"], "left").select(
        "doc", "style_id", "color", "opacity")
    return styles.select("doc", "style_id", "color", "opacity").unionByName(resolved)


def reachable_documents(
    links: DataFrame, roots: DataFrame, bounds: Column | None = None,
    max_depth: int = 6, max_docs: int = 600,
) -> DataFrame:
    """(root_id, doc, depth, within_limits) of a breadth-first walk.

    ``links``: parent, doc and, for pruning by viewport, region (bounds struct
    or null). ``roots``: root_id, doc. ``LEVELS`` levels are one plan, ended by an
    anti-join and a checkpoint, until its last level finds nothing new. The walk is
    always whole; ``within_limits`` is false for a root that needs more levels
    or documents than the caller allows.
    """
    usable = links
    if bounds is not None:
        usable = usable.where(G.bbox_intersects("region", bounds))
    edges = usable.select(F.col("parent").alias("doc"), F.struct(F.col("doc").alias("doc")).alias("_child")).distinct()
    frontier = durable(roots.select("root_id", "doc", F.lit(0).alias("depth")))
    seen, level = frontier, 0

    def step(walked: DataFrame) -> DataFrame:
        """What was walked, and one level more; what is met again keeps its least depth."""
        own, next_ = F.struct("doc", "depth"), F.struct(F.col("_child.doc").alias("doc"), (F.col("depth") + 1).alias("depth"))
        both = F.when(F.col("_child").isNull(), F.array(own)).otherwise(F.array(own, next_))
        return walked.join(edges, "doc", "left").select("root_id", F.explode(both).alias("_at")).groupBy(
            "root_id", F.col("_at.doc").alias("doc")).agg(F.min("_at.depth").alias("depth"))

    while not frontier.isEmpty():
        walked = frontier
        for _ in range(LEVELS):
            walked = step(walked)
        new = durable(walked.where(F.col("depth") > level).join(seen, ["root_id", "doc"], "left_anti"))
        level += LEVELS
        frontier = new.where(F.col("depth") == level)
        seen = together(seen, new, level // LEVELS)
    limits = seen.groupBy("root_id").agg(
        ((F.count(F.lit(1)) <= max_docs) & (F.max("depth") <= max_depth)).alias("within_limits"))
    return seen.join(limits, "root_id")


def document_links(
    found: DataFrame, cache_root: str, surficial: bool = True,
    official_host: str = OFFICIAL_HOST, official_folder: str = OFFICIAL_FOLDER,
) -> DataFrame:
    """(parent, pos, doc, region, problem) of the links to follow, from ``network_links`` whose documents are named by address.

    Addresses are resolved against their document; the surficial layer follows only links of its rule; an address of the
    publisher's folder is the cached copy's. ``problem`` is ``outside`` for a document that is not under the cache.
    """
    address = X.resolve_url("href", "doc")
    resolved = found.select(F.col("doc").alias("parent"), "pos", "name", "region", address.alias("_to"))
    if surficial:
        resolved = resolved.where(X.follow_link("name", F.coalesce("_to", F.lit(""))))
    path = X.url_path("_to")
    copied = F.concat(F.lit(f"{cache_root}polygons/"), F.substring_index(path, official_folder, -1))
    to = F.when(F.col("_to").rlike(official_host) & path.contains(official_folder), copied).otherwise(F.col("_to"))
    inside = F.coalesce(to.startswith(f"{cache_root}polygons/"), F.lit(False))
    return resolved.select("parent", "pos", to.alias("doc"), "region", F.when(~inside, "outside").alias("problem"))


def linked_documents(
    links: DataFrame, documents: DataFrame, roots: DataFrame, bounds: Column | str | None = None,
    max_depth: int = 6, max_docs: int = 600,
) -> DataFrame:
    """(root_id, doc, depth, problem, within_limits) of the documents that a walk from each root loads.

    ``links`` as of ``document_links``, ``documents`` holds the known addresses (doc), ``roots`` (root_id, doc and what
    ``bounds`` names: a viewport for each root). A link whose region misses the root's viewport is not followed; one without region always
    is. A document outside the cache or not there is reported with its problem and leads nowhere. Cycles and
    shared documents are loaded once for each root. Each level is one equi-join and one anti-join on slim rows (no text moves), cut by a
    checkpoint; the walk is whole, and ``within_limits`` says whether the root kept to the caller's depth and number of documents.
    """
    kept = [F.col("root_id"), F.col("doc")] + ([] if bounds is None else [(F.col(bounds) if isinstance(bounds, str) else bounds).alias("_view")])
    known = documents.select("doc").distinct().withColumn("_there", F.lit(True))
    edges = durable(
        links.join(known, "doc", "left").select(
            F.col("parent").alias("_parent"), "doc", "region",
            F.coalesce("problem", F.when(F.col("_there").isNull(), "missing")).alias("problem")).distinct())
    start = roots.select(*kept).distinct().join(known, "doc", "left")
    frontier = durable(start.select(
        "root_id", "doc", F.lit(0).alias("depth"), F.when(F.col("_there").isNull(), "missing").alias("problem"), *kept[2:] and ["_view"]))
    seen = frontier.select("root_id", "doc", "depth", "problem")
    level = 0
    while not frontier.isEmpty():
        level += 1
        open_ = frontier.where("problem IS NULL").withColumnRenamed("doc", "_parent").drop("depth", "problem")
        step = open_.join(edges, "_parent")
        if bounds is not None:
            step = step.where(F.col("region").isNull() | G.bbox_intersects("region", "_view"))
        step = step.drop("_parent", "region").dropDuplicates(["root_id", "doc"])
        frontier = durable(step.join(seen.select("root_id", "doc"), ["root_id", "doc"], "left_anti").withColumn("depth", F.lit(level)))
        seen = together(seen, frontier.select("root_id", "doc", "depth", "problem"), level)
    loaded = F.col("problem").isNull()
    limits = seen.groupBy("root_id").agg(
        ((F.count_if(loaded) <= max_docs) & (F.max(F.when(loaded, F.col("depth"))) <= max_depth)).alias("within_limits"))
    return seen.join(limits, "root_id").select("root_id", "doc", "depth", "problem", F.coalesce("within_limits", F.lit(True)).alias("within_limits"))
