"""millrace: a PySpark-native engine for language-model corpora.

Sub-packages: ``functions`` (column expressions and Arrow helpers), ``operators``
(DataFrame -> DataFrame operators), ``sources`` (readers and writers), ``plans``
(named queries with their SQL), ``streaming`` (incremental ingest) and, optional,
``llm`` (training-data operators; nothing outside it imports it).
"""

__version__ = "0.1.0"
