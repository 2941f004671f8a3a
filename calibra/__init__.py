"""calibra: a Spark-native engine for preparing tabular data and benchmarking
binary classifiers on it.

Every operator is a function ``DataFrame -> DataFrame`` (plus, where a fit is
involved, a small parameter DataFrame).  Work runs on executors; the driver only
ever holds bounded parameters (medians, vocabularies, means, landmark sets).
"""

from calibra.session import get_spark, checkpoint_dir
from calibra.spec import FeatureSpec

__all__ = ["get_spark", "checkpoint_dir", "FeatureSpec"]
