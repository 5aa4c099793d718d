"""evalspark: a Spark-native engine for scoring and ranking many models on many tables.

Every operator is a pure ``DataFrame -> DataFrame`` function whose grouping columns
(unit keys such as ``seed``, ``key``, ``model``) are plain columns, so the same plan
runs unchanged from a laptop fixture to a cluster-sized result store.
"""

__version__ = "0.1.0"

UNIT = ("seed", "key", "model")
