"""errata: a Spark-native engine for measuring and improving the quality of
machine-written SQL workloads.

Every operator is a ``DataFrame -> DataFrame`` job made of Spark SQL
expressions, joins, windows and aggregations.  Sub-packages:

* ``functions``  reusable column expressions (name normalisation, md5 draws,
  literal typing, regex rule tables, fixed vocabularies)
* ``sources``    loaders for the file formats of a text-to-SQL workload and the
  derivation of the engine's canonical input tables from the test tables
* ``operators``  the jobs: trees, catalog graph, linking, detection,
  evaluation, corpus synthesis, prompts, training rows, catalog rendering
* ``plans``      the registry of named queries used by the driver and bench
* ``streaming``  stateless row-wise jobs wired to Structured Streaming
"""

__version__ = "0.1.0"
