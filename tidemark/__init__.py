"""tidemark: table and multi-series analytics expressed as Spark DataFrame plans.

Sub-packages
------------
sources    scans and sinks (parquet tables, CSV with fixed schemas, partitioned layouts)
functions  column-expression builders (pure ``pyspark.sql.functions`` compositions)
operators  DataFrame -> DataFrame operators: relational, profiling, series, features,
           splits, models and evaluation
plans      multi-step compositions (cleaning, direction scoring, stacking) and the
           query catalogue used by ``__spark_entry__``
streaming  notes on streaming (the analysed workload has no unbounded sources)
"""

__version__ = "0.1.0"
