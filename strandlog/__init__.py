"""Versioned entity-graph analytics as Spark DataFrame operators.

One append-only change log is the only stored truth; snapshots, graph hops,
incremental feeds and maintenance are all derived from it declaratively.
"""

__version__ = "0.1.0"
