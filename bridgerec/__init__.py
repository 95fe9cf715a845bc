"""bridgerec: single- and cross-domain rating prediction on Spark DataFrames.

Subpackages: ``sources`` (rating readers and derivation), ``functions``
(column expressions over factor arrays), ``operators`` (metrics, model
fitting, clustering, transfer), ``plans`` (registered queries, pipelines and
their DuckDB oracles), ``streaming`` (empty: the reference has no streams).
"""
