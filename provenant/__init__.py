"""Spark-native provenance and behaviour analytics.

The package declares every operator as a DataFrame transformation, so that
Catalyst sees one logical plan from scan to result.  ``sources`` reads and
writes extracts, ``functions`` holds scalar column helpers, ``operators`` the
relational, graph and learning operators, ``plans`` whole queries over the
driver tables, and ``streaming`` the incremental first-funding sink.
"""

__all__ = ["functions", "operators", "plans", "sources", "streaming"]
