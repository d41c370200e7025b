"""Operators for training-data pipelines: deduplication, scoring, mixing, packing, counting.

Nothing outside this subpackage imports it. Every operator takes a SparkSession and
DataFrames and returns DataFrames; thin queries over whole tables are in ``queries``.
"""
