"""A governed document library as DataFrames: operators, sources, plans and streams for PySpark."""

__version__ = "0.1.0"
