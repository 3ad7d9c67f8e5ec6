"""pricelens: Spark-native analytics over panels of priced items.

Every public operator is a plain ``DataFrame -> DataFrame`` function (or a
column-expression builder) that works on any table with an entity key, a date
and a value.  Sub-packages:

* ``sources``   – scans, landed-document parsers and sinks
* ``functions`` – column-expression helpers (text, dates, maths, nested types)
* ``operators`` – relational operators (as-of joins, windows, matching, ...)
* ``plans``     – composed queries over the panel views, with DuckDB oracles
* ``streaming`` – incremental (resume-by-key) ingestion on Structured Streaming
"""

__version__ = "0.1.0"
