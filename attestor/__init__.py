"""Attestor: dated research evidence as Spark DataFrames.

Every public function takes and returns DataFrames; nothing here owns a query
engine.  Sub-packages:

* ``sources``    readers, writers and the table registry
* ``functions``  column expressions (identity, text, dates, URLs)
* ``operators``  reusable DataFrame operators (joins, ranking, components ...)
* ``plans``      whole pipelines (find, timeline, ingest, origins, citations)
* ``streaming``  Structured Streaming twins of the incremental operators
* ``queries``    the queries that ``__spark_entry__`` registers
"""
