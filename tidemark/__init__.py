"""tidemark - product and subscription analytics as composable Spark DataFrame transformations.

Every operator is a function ``DataFrame(s) -> DataFrame``.  The name refers to the observation
cutoff: the latest event time seen, beyond which a cohort is immature and may not enter a denominator.
"""

from tidemark.session import get_spark, tune

__all__ = ["get_spark", "tune"]
