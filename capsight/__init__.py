"""capsight — capacity-utilization and tabular insights on Spark.

Every operator is a plain ``DataFrame -> DataFrame`` function built from
``pyspark.sql.functions`` expressions, windows, joins and aggregates, and it
computes all groups in one pass. Nothing here creates a session except
:mod:`capsight.session`, which tests and the bench use.
"""

from capsight.roles import Roles

__all__ = ["Roles"]
