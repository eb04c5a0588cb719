"""Operations of a large-scale training-data pipeline, on Spark DataFrames.

Nothing outside this folder imports it.  Every operator takes a DataFrame with
at least the columns it names, ignores further ones, and keeps no state on
machine-local disk: what must be cut from the lineage is a Parquet table under
``spark.checkpoint.dir`` (see :mod:`relengine.llm.common`).
"""
