"""Lodestrata: a Spark-native evidence analytics engine.

The package is layered: ``sources`` (typed readers and sinks), ``functions`` (column
expressions), ``operators`` (DataFrame in, DataFrame out), ``plans`` (named queries built from
operators) and ``streaming`` (Structured Streaming twins).  Nothing here imports the optional
``llm`` subpackage.
"""

__version__ = "0.1.0"
