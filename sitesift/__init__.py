"""Site screening over tables of sites, geology polygons, imagery catalogs,
survey labels and contour lines, written as PySpark DataFrame operators."""

__version__ = "0.1.0"
