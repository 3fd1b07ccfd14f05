"""rasterweave: layered raster data as Spark DataFrames, with DataFrame and SQL plans for its operators."""

__version__ = "0.1.0"
