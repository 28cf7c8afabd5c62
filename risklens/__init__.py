"""risklens: learner-outcome risk analytics expressed as Spark DataFrame plans.

Sub-packages
------------
sources    readers for the raw CSV tables, the uploaded class files, the
           driver test tables and the parquet state tables.
functions  column-expression helpers (coercion, lookups, formatting).
operators  DataFrame -> DataFrame building blocks (features, encoding,
           drift, metrics, reports, alerts, ensemble, attribution).
plans      composed jobs (training set, batch scoring) and the query
           catalogue used by ``__spark_entry__``.
streaming  incremental ingest of newly arriving upload files.
"""

__version__ = "0.1.0"
