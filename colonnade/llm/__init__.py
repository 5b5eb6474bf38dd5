"""Training-data operators: extraction, near-dedup, packing, scoring, privacy and mixing.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames, keeps driver state bounded by a documented parameter, and uses only the
folder named by ``spark.checkpoint.dir`` for tables that cut lineage.
"""
