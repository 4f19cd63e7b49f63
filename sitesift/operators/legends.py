"""Official map legends as dimension tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Ontario Geological Survey, Miscellaneous Release - Data 128,
# surficial units. code|colour|title|detail
SURFICIAL_LEGEND = """\
21|#6c2893|Man-made deposits|Fill, sewage lagoon, landfill, urban development
20|#b2b1b1|Organic deposits|Peat, muck, marl
19|#b9652d|Modern alluvial deposits|Clay, silt, sand, gravel, may contain organic remains
18|#811d8f|Colluvial deposits|Boulders, scree, talus, undifferentiated landslide materials
17|#f7f2b8|Eolian deposits|Fine to very fine sand and silt
16|#e9d613|Coarse-textured marine deposits|Sand, gravel, minor silt and clay
16a|#e9d613|Coarse-textured marine deposits|Deltaic deposits
16b|#e9d613|Coarse-textured marine deposits|Littoral deposits
16c|#e9d613|Coarse-textured marine deposits|Foreshore and basinal deposits
15|#2e3696|Fine-textured marine deposits|Silt and clay, minor sand and gravel
14|#f4ea18|Coarse-textured lacustrine deposits|Sand, gravel, minor silt and clay
14a|#f4ea18|Coarse-textured lacustrine deposits|Deltaic deposit
14b|#f4ea18|Coarse-textured lacustrine deposits|Littoral deposits
14c|#f4ea18|Coarse-textured lacustrine deposits|Foreshore and basinal deposits
13|#4bbab6|Fine-textured lacustrine deposits|Silt and clay, minor sand and gravel
12|#b9652d|Older alluvial deposits|Clay, silt, sand, gravel, may contain organic remains
11|#e9d613|Coarse-textured glaciomarine deposits|Sand, gravel, minor silt and clay
11a|#e9d613|Coarse-textured glaciomarine deposits|Deltaic deposits
11b|#e9d613|Coarse-textured glaciomarine deposits|Littoral deposits
11c|#e9d613|Coarse-textured glaciomarine deposits|Foreshore and basinal deposits
10|#57c7c6|Fine-textured glaciomarine deposits|Silt and clay, minor sand and gravel
10a|#57c7c6|Fine-textured glaciomarine deposits|Massive to well laminated
10b|#57c7c6|Fine-textured glaciomarine deposits|Interbedded silt and clay and gritty, pebbly flow till and rainout deposits
9|#f4ea18|Coarse-textured glaciolacustrine deposits|Sand, gravel, minor silt and clay
9a|#f4ea18|Coarse-textured glaciolacustrine deposits|Deltaic deposits
9b|#f4ea18|Coarse-textured glaciolacustrine deposits|Littoral deposits
9c|#f4ea18|Coarse-textured glaciolacustrine deposits|Foreshore and basinal deposits
8|#9eded4|Fine-textured glaciolacustrine deposits|Silt and clay, minor sand and gravel
8a|#9eded4|Fine-textured glaciolacustrine deposits|Massive to well laminated
8b|#9eded4|Fine-textured glaciolacustrine deposits|Interbedded silt and clay and gritty, pebbly flow till and rainout deposits
7|#fad465|Glaciofluvial deposits|River deposits and delta topset facies
7a|#fad465|Glaciofluvial deposits|Sandy deposits
7b|#fad465|Glaciofluvial deposits|Gravelly deposits
6|#f69c19|Ice-contact stratified deposits|Sand and gravel, minor silt, clay and till
6a|#f69c19|Ice-contact stratified deposits|In moraines, eskers, kames and crevasse fills
6b|#f69c19|Ice-contact stratified deposits|In subaquatic fans
5|#9cd867|Till|Silty sand to sand-textured till on Precambrian terrain
5a|#9cd867|Till|Silty sand to sand-textured till on Precambrian terrain
5b|#8fcc26|Till|Stone-poor, sandy silt to silty sand-textured till on Paleozoic terrain
5c|#94d226|Till|Stony, sandy silt to silty sand-textured till on Paleozoic terrain
5d|#2aad43|Till|Clay to silt-textured till (derived from glaciolacustrine deposits or shale)
5e|#219b45|Till|Undifferentiated older tills, may include stratified deposits
4|#d390cc|Bedrock-drift complex in Paleozoic terrain|
4a|#d390cc|Bedrock-drift complex in Paleozoic terrain|Primarily till cover
4b|#d390cc|Bedrock-drift complex in Paleozoic terrain|Primarily stratified drift cover
3|#d390cc|Paleozoic bedrock|Sedimentary (Paleozoic) bedrock
2|#f8bec4|Bedrock-drift complex in Precambrian terrain|
2a|#f8bec4|Bedrock-drift complex in Precambrian terrain|Primarily till cover
2b|#f8bec4|Bedrock-drift complex in Precambrian terrain|Primarily stratified drift cover
1|#f8bec4|Precambrian bedrock|Precambrian bedrock
"""

# Miscellaneous Release - Data 126 Revision 1, bedrock units.
# code|colour (without #)|material
BEDROCK_UNITS = """\
63|e3d7a4|Kaolinitic clay, clay, sand, lignite
61|5a8667|Shale: Port Lambton Gp.
60|6da785|Shale
59|7ab58b|Limestone, dolostone, shale
58|e6bd9f|Sandstone, dolostone, limestone
57|e1c37c|Limestone, dolostone, shale, sandstone, gypsum, salt
56|e3d0a4|Sandstone, shale, dolostone, siltstone
55|00b4cc|Shale, limestone, dolostone, siltstone
54|0dbcd9|Limestone, dolostone, shale, arkose, sandstone
53|8fe4e6|Dolostone, sandstone: Beekmantown Gp.
52|efe151|Conglomerate, sandstone, shale, dolostone: Potsdam Gp.; Nepean Fm.; Covey Hill Fm.
51|8f0c40|Tectonite unit: tectonites, straight gneisses, porphyroclastic gneisses, unsubdivided gneisses in major deformation zones, mylonites, protomylonites
50|b31818|Late felsic plutonic rocks: granodiorite, granite, syenite, pegmatite, alkalic granite, migmatitic gneisses
49|0f7b82|Mafic to ultramafic plutonic rocks: diorite, gabbro, peridotite, pyroxenite, anorthosite, derived metamorphic rocks
48|f38447|Alkalic plutonic rocks: nepheline syenite, alkalic syenite, fenite; associated mafic, ultramafic and carbonatitic rocks
47|fe4f4f|Early felsic plutonic rocks: granodiorite, tonalite, monzogranite, syenogranite; derived gneisses and migmatites
46|56e6fe|Carbonate metasedimentary rocks: marble, calc-silicate rocks, skarn, tectonic breccias
45|dfeb1c|Clastic metasedimentary rocks: conglomerate, wacke, quartz arenite, arkose, limestone, siltstone, chert, minor iron formation, minor metavolcanic rocks
44|16a40e|Mafic to felsic metavolcanic rocks: flows, tuffs, breccias, minor iron formation, minor metasedimentary rocks; includes reworked pyroclastic units, amphibolite
43|fd916c|Felsic igneous rocks: tonalite, granodiorite, monzonite, granite, syenite; derived gneisses
42|af005e|Anorthosite and alkalic igneous rocks: anorthosite, anorthositic gabbro, gabbro and related gneisses, nepheline syenite, alkalic syenite
41|d5b09c|Migmatitic rocks and gneisses of undetermined protolith: commonly layered biotite gneisses and migmatites; locally includes quartzofeldspathic gneisses, orthogneisses, paragneisses
40|8eca06|Mafic rocks: amphibolite, gabbro, diorite, mafic gneisses
39|d18a8d|Gneisses of metasedimentary origin: quartzofeldspathic gneisses, pelitic to semi-pelitic gneisses, calc-silicate gneisses, minor quartzite, minor marble and marble breccia
38|ca0683|Carbonate-alkalic intrusive suite (443.7 Ma to 600 Ma): carbonatite, nepheline syenite, alkalic syenite, ijolite, fenite; associated mafic and ultramafic intrusions
37|fb6400|Mafic intrusive rocks
36|b3af5c|Sandstone, shale, conglomerate: Jacobsville Gp.; Oronto Gp.
35|8f008d|Alkalic intrusive suite and carbonatite (circa 1.1 to 1.2 Ga): alkalic syenite, ijolite, nepheline syenite, fenite, associated mafic and ultramafic rocks, and minor carbonatite
34|fdc577|Mafic dikes and related intrusive rocks (Keweenawan age) (circa 1.1 to 1.2 Ga)
33|4e4e4e|Mafic intrusive rocks and mafic dikes
32|d0cd93|Osler Gp., Mamainse Point Fm., Michipicoten Island Fm.
31|e4da6f|Sibley Gp. (circa 1.34 Ga): conglomerate, sandstone, shale
30|cd0072|Felsic intrusive rocks
29|ab0000|Sudbury Igneous Complex (1850 Ma): norite, gabbro, granophyre
28|758925|Whitewater Gp.: fragmental rocks, mudstone, wacke
27|71467a|Carbonatite-alkalic intrusive suite (circa 1.8 to 1.9 Ga): carbonatite complexes, nepheline syenite, alkalic syenite, ijolite, fenite; associated mafic and ultramafic rocks
26|018200|Mafic intrusive rocks, mafic dikes and mafic sills
25|92988d|Trans-Hudson Orogen Supracrustal rocks / sedimentary rocks (Sutton Inliers): dolostone, chert breccias, argillite, wacke, conglomerate, iron formation
24|91977a|Sedimentary rocks (Animikie Group): wacke, shale, iron formation, limestone, minor volcanic rocks, conglomerate, taconite, algal chert, carbonate rocks, argillite-tuff
23|ebd3f8|Mafic and related intrusive rocks and mafic dikes
22|ef898b|Felsic intrusive rocks (Murray Granite 2388 Ma, Creighton Granite 2333 Ma): granite
21|c57943|Cobalt Gp.: siltstone, argillite, sandstone, conglomerate
20|9a9fd8|Quirke Lake Gp.: sandstone, siltstone, conglomerate, limestone, dolostone
19|bdc0d5|Hough Lake Gp.: siltstone, wacke, argillite, quartz-feldspar sandstone, conglomerate, sandstone
18|727dd7|Elliot Lake Gp.: siltstone, wacke, argillite, quartz-feldspar sandstone, conglomerate, mafic, intermediate and felsic metavolcanic rocks, intercalated metasedimentary rocks and epiclastic rocks
17|003cc8|Mafic and ultramafic intrusive rocks and mafic dikes
16|f6d2fb|Hornblendite - nepheline syenite suite: pyroxenite, diorite, monzonite, syenite, nepheline syenite (saturated to undersaturated suite)
15|fc5580|Massive granodiorite to granite: massive to foliated granodiorite to granite
14|e37da6|Diorite-monzodiorite-granodiorite suite: diorite, quartz diorite, minor tonalite, monzonite, granodiorite, syenite and hypabyssal equivalents (saturated to oversaturated suite)
13|fed1e9|Muscovite-bearing granitic rocks: muscovite-biotite and cordierite-biotite granite, granodiorite-tonalite
12|fdbdbf|Foliated tonalite suite: tonalite to granodiorite - foliated to massive
11|fdd3c1|Gneissic tonalite suite: tonalite to granodiorite - foliated to gneissic - with minor supracrustal inclusions
10|4aadfc|Mafic and ultramafic rocks: gabbro, anorthosite, ultramafic rocks
9|fef6a4|Coarse clastic metasedimentary rocks: mainly coarse clastic metasedimentary rocks, with minor, mainly alkalic, mafic to felsic metavolcanic flows, tuffs and breccias
8|596591|Migmatized supracrustal rocks: metavolcanic rocks, minor metasedimentary rocks, mafic gneisses of uncertain protolith, granitic gneisses
7|d2d2d2|Metasedimentary rocks: wacke, siltstone, arkose, argillite, slate, mudstone, marble, chert, iron formation, minor metavolcanic rocks, conglomerate, arenite, paragneiss, migmatites
6|dcd085|Felsic to intermediate metavolcanic rocks: rhyolitic, rhyodacitic, dacitic and andesitic flows, tuffs and breccias, chert, iron formation, minor metasedimentary and intrusive rocks; related migmatites
5|8faa7c|Mafic to intermediate metavolcanic rocks: basaltic and andesitic flows, tuffs and breccias, chert, iron formation, minor metasedimentary and intrusive rocks, related migmatites
4|47889c|Mafic to ultramafic metavolcanic rocks: mafic metavolcanic and basaltic rocks with minor komatiitic flows, metasedimentary and pyroclastic rocks
3|12769a|Mafic metavolcanic and metasedimentary rocks: mafic metavolcanic rocks, minor iron formation
2|b1e436|Felsic to intermediate metavolcanic rocks: rhyolitic, rhyodacitic, dacitic and andesitic flows, tuffs and breccias
1|0f7c80|Metasedimentary rocks and mafic to ultramafic metavolcanic rocks: coarse clastic metasedimentary rocks, marble, quartz arenite, iron formation, komatiite, mafic metavolcanic rocks, and minor felsic metavolcanic rocks
"""

# The same release, sub-units (the colour is the parent's). code|label
BEDROCK_SUBUNITS = """\
63a|Mattagami Fm.; Mistuskwia Beds
63b|Evans Strait Fm.
60a|Kettle Point Fm.
60b|Long Rapids Fm.
59a|Hamilton Gp.
59b|Marcellus Fm.
59c|Dundee Fm.
59d|Detroit River Gp.; Onondaga Fm.
59e|Williams Island Fm.
59f|Murray Island Fm.
59g|Moose River Fm.
59h|Kwataboahegan Fm.
58a|Bois Blanc Fm.; Oriskany Fm.
58b|Stooping River Fm.
58c|Sextant Fm.
57a|Bass Islands Fm.
57b|Bertie Fm.
57c|Salina Fm.
57d|Kenogami River Fm. (Upper Silurian to Lower Devonian)
56a|Guelph Fm. (also present in the Upper Silurian)
56b|Lockport Fm.
56c|Amabel Fm.
56d|Clinton Gp.; Cataract Gp.
56e|Thornloe Fm.; Earlton Fm.
56f|Wabi Gp.
56g|Attawapiskat Fm. (also present in the Upper Silurian)
56h|Ekwan River Fm.
56i|Severn River Fm.
55a|Queenston Fm.
55b|Georgian Bay Fm.; Blue Mountain Fm.; Billings Fm.; Collingwood Mb.; Eastview Mb.
55c|Liskeard Gp.
55d|Red Head Rapids Fm.
55e|Churchill River Gp.
55f|Bad Cache Rapids Gp.
54a|Ottawa Gp.; Simcoe Gp.; Shadow Lake Fm. (now considered Upper Ordovician)
54b|Chazy Gp.; Rockcliffe Fm.
50a|Granitic and syenitic gneisses
50b|Granitic gneisses with metasedimentary xenoliths, migmatites, injection gneisses, pegmatites
49a|Gabbro
49b|Diorite
49c|Anorthosite, gabbroic anorthosite
48a|Syenite
48b|Nepheline syenite
47a|Monzo- and syenogranite
47b|Granodiorite
47c|Trondhjemite
47d|Tonalite
38a|Intrusions of uncertain age
37a|Grenville or Rideau mafic dike swarm (575-590 Ma)
37b|Frontenac mafic dike swarm (circa 1160 Ma)
37c|Gabbro, diorite, ultramafic rocks, and granophyre
35a|Martison Carbonatite Complex
34a|Logan and Nipigon mafic sills (circa 1100-1115 Ma)
34b|Mafic sills and dikes (circa 1130-1180 Ma), including the Mine Centre dike (circa 1137±20 Ma), the Empey Lake dike (circa 1178±31 Ma), and the Kipling (Abitibi) dike (circa 1140 Ma)
34c|Ultramafic, gabbroic and granophyric intrusions (probably related to unit 35)
34d|Felsic to intermediate intrusive rocks
34e|Abitibi swarm (1141 Ma) mafic dikes
33a|Mackenzie mafic dike swarm (1267 Ma)
33b|Sudbury mafic dike swarm (circa 1235-1238 Ma)
32a|Basalt and associated conglomerate and arkose
32b|Rhyolite, quartz-feldspar porphyry; associated conglomerate and arkose
30a|Granite, alkali granite, granodiorite, quartz-feldspar porphyry; minor related volcanic rocks (1.5 to 1.6 Ga)
30b|Killarney monzogranite and granitic rocks (1.7 and 1.4 Ga)
30c|Intermediate to felsic volcanic rocks (1.8 to 1.9 Ga)
29a|Granophyre
29b|Norite-gabbro, quartz norite, sublayer and offset rocks
28a|Chelmsford Formation: wacke, minor siltstone
28b|Onwatin Formation: carbonaceous slate
28c|Onaping Formation: lapilli tuff, breccia, felsic flows and intrusions, minor carbonate and chert
26a|Molson mafic dike swarm (circa 1889 to 1871 Ma) and mafic sills of the Sutton Inliers (circa 1871 Ma)
26b|Pickle Crow mafic dike; normally magnetized northwest-trending subswarm (Molson swarm) (circa 1876 Ma)
26c|Pickle Crow mafic dike; reversely magnetized northwest-trending subswarm (Molson swarm) (circa 1876 Ma)
26d|Mafic dikes and mafic plutons of uncertain age; gabbro, diorite, quartz diorite
26e|North Channel mafic dike swarm
25a|Mafic and ultramafic metavolcanic rocks, metasedimentary rocks, differentiated mafic to ultramafic intrusions of the Fox River belt
25b|Undifferentiated clastic and carbonate metasedimentary rocks
25c|Sutton Inliers – Sutton Ridges Formation: unsubdivided clastic metasedimentary rocks (including wacke, siltstone, argillite, chert breccia and conglomerate), and chert-banded and clastic iron formation
25d|Sutton Inliers – Nowashe Formation: carbonate metasedimentary rocks (dolomite, cherty dolomite, stromatolitic dolomite, argillaceous dolomite)
25e|Undifferentiated clastic metasedimentary migmatite
24a|Rove Formation: argillite, shale, wacke, minor volcanic rocks
24b|Gunflint Formation: conglomerate, taconite, algal chert, chert, carbonate rocks, argillite-tuff
23a|Marathon mafic dike; north-northwest to north-northeast-trending subswarm (circa 2101 to 2126 Ma)
23b|Fort Frances mafic dike; northwest-trending subswarm (circa 2075 Ma)
23c|Marathon, Kapuskasing or Biscotasing mafic dike; northeast-trending subswarm (circa 2101-2126 or circa 2167-2171 Ma)
23d|Nipissing mafic sills (2219 Ma): mafic sills, mafic dikes and related granophyre
23e|Biscotasing mafic dike; north-northeast-trending swarm (circa 2167-2171 Ma)
23f|Mafic dikes of uncertain age
23g|Mafic plutons of uncertain age
21a|Bar River Formation: quartz sandstone, hematitic sandstone, sandstone
21b|Gordon Lake Formation: siltstone, argillite, sandstone
21c|Lorrain Formation: quartz sandstone, minor conglomerate, siltstone
21d|Gowganda Formation: conglomerate, sandstone, siltstone, argillite
20a|Serpent Formation: quartz-feldspar sandstone, sandstone with minor siltstone, calcareous siltstone and conglomerate
20b|Espanola Formation: limestone, dolostone, siltstone, sandstone
20c|Bruce Formation: conglomerate with minor sandstone and siltstone
19a|Mississagi Formation: quartz-feldspar sandstone, argillite and conglomerate
19b|Pecors Formation: siltstone, argillite, wacke, minor sandstone
19c|Ramsay Lake Formation: conglomerate, minor sandstone, siltstone
18a|McKim Formation: siltstone, wacke, argillite
18b|Matinenda Formation: quartz-feldspar sandstone, conglomerate, sandstone
18c|Volcanic rocks: includes mafic, intermediate and felsic metavolcanic rocks, intercalated metasedimentary rocks and epiclastic rocks
17a|Matachewan mafic dike swarm (circa 2454 Ma)
17b|Gabbro, anorthosite
16a|Hornblendite, pyroxenite
16b|Gabbro, diorite, monzonite
16c|Syenite, nepheline and/or foid-bearing syenite
15a|Potassium feldspar megacrystic units
14a|Diorite, monzonite, quartz monzonite
14b|Granodiorite, granite
14c|Syenite
12a|Biotite tonalite to granodiorite
12b|Hornblende tonalite to granodiorite
10a|Gabbro
10b|Anorthosite
10c|Ultramafic rocks
9a|Metasedimentary rocks: conglomerate, arkose, arenite, wacke, sandstone, siltstone, argillite
9b|Alkaline metavolcanic rocks: mafic to felsic metavolcanic flows, tuffs and breccias
7a|Wacke, siltstone, arkose
7b|Argillite, slate, mudstone
7c|Marble, chert, iron formation, minor metavolcanic rocks
7d|Conglomerate and arenite
7e|Paragneiss and migmatites
6a|Dacitic and andesitic flows, tuffs and breccias
6b|Rhyolitic, rhyodacitic flows, tuffs and breccias
5a|Andesitic flows, tuffs and breccias with minor rhyolites
5b|Basaltic and andesitic flows, tuffs and breccias
4a|Ultramafic metavolcanic rocks
4b|Mafic metavolcanic rocks, metasedimentary rocks and pyroclastic rocks
"""

GEOPHYSICS_NOTE = "Lithologic information interpreted from geophysical data."
LEGEND_SCHEMA = "code STRING, title STRING, detail STRING, material STRING, color STRING"


def _rows(text: str) -> list[list[str]]:
    return [line.split("|") for line in text.strip().splitlines()]


def surficial_codes() -> list[str]:
    return [row[0] for row in _rows(SURFICIAL_LEGEND)]


def surficial_legend(spark: SparkSession) -> DataFrame:
    """code, title, detail, material, color.

    A sub-unit's material is its parent's detail, except under unit 5.
    """
    details = {code: detail for code, _, _, detail in _rows(SURFICIAL_LEGEND)}
    rows = []
    for code, color, title, detail in _rows(SURFICIAL_LEGEND):
        parent = code.rstrip("abcdefgh")
        material = details[parent] if parent not in (code, "5") else ""
        rows.append((code, title, detail, material, color))
    return spark.createDataFrame(rows, LEGEND_SCHEMA)


def bedrock_legend(spark: SparkSession) -> DataFrame:
    """Like ``surficial_legend``; a sub-unit keeps the material and colour of its parent."""
    parents = {code: (color, label) for code, color, label in _rows(BEDROCK_UNITS)}
    rows = [(c, label, "", label, "#" + color) for c, (color, label) in parents.items()]
    for code, label in _rows(BEDROCK_SUBUNITS):
        color, material = parents[code.rstrip("abcdefghi")]
        rows.append((code, label, label, material, "#" + color))
    return spark.createDataFrame(rows, LEGEND_SCHEMA)


def legend_lookup(features: DataFrame, legend: DataFrame, code: str = "code") -> DataFrame:
    """``features`` with the legend's title, detail, material and color.

    A left join on the code without the geophysics prefix: an unknown code
    stays null and never falls back to its parent. The legend is a dimension
    of a few hundred rows, so Spark's own size check decides on broadcasting.
    """
    bare = F.regexp_replace(F.col(code), "^g", "")
    joined = features.withColumn("_bare", bare).join(
        legend.withColumnRenamed("code", "_bare"), "_bare", "left").drop("_bare")
    prefixed = F.col(code).startswith("g") & F.col("title").isNotNull()
    noted = F.concat_ws("; ", F.nullif(F.col("detail"), F.lit("")), F.lit(GEOPHYSICS_NOTE))
    return joined.withColumn("detail", F.when(prefixed, noted).otherwise(F.col("detail")))


def unit_description(material: Column | str, detail: Column | str) -> Column:
    """Material and detail, each once, joined by "; "."""
    parts = F.array(
        F.col(material) if isinstance(material, str) else material,
        F.col(detail) if isinstance(detail, str) else detail)
    return F.array_join(F.array_distinct(F.filter(parts, lambda p: p != "")), "; ")
