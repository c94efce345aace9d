"""Spark-native Bayesian matrix factorisation and the analytics around it.

The subpackages hold matrix operators, sources and sinks, scalar functions,
query plans and incremental processing.  Nothing here imports ``factorloom.llm``.
"""

__version__ = "0.1.0"
