"""A Spark-native analytics engine for georeferenced, multi-band images held as DataFrames of pixels."""
