"""trylens: exception-site analytics for code corpora on Spark.

Modules:

* ``trylens.functions`` - column expressions: Python-compatible strip/split/
  slice, the Java identifier test, quote-aware token folds.
* ``trylens.sources`` - the derived code corpus, parquet and text sources and
  sinks (positional text pairing included).
* ``trylens.operators`` - slicing, line structure, spans, labels, encoders,
  metrics, ranking, vectors, naive Bayes models, external-model scoring.
* ``trylens.plans`` - end-to-end flows and the query registry with DuckDB
  oracle SQL.
* ``trylens.streaming`` - streaming prediction and the idempotent sink.

Functions take and return DataFrames or Columns; nothing holds a global
session (``trylens.session.local_session`` is for tests and benchmarks).
"""

__version__ = "0.1.0"
