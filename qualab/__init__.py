"""qualab — data quality, data preparation and model benchmarking on Spark DataFrames.

Every operator takes a DataFrame and returns a lazy DataFrame built from native Spark
expressions; nothing is collected to the driver except small, size-bounded plan inputs
(column lists, fixed-size quantile probes).
"""

__version__ = "0.1.0"
