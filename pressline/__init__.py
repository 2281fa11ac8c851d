"""pressline: corpus-to-token-stream analytics as Spark DataFrame operators.

Every public operator is a plain ``DataFrame -> DataFrame`` function built from
native Spark expressions, so it composes with ``DataFrame.transform`` and lets
Catalyst prune, push down and plan the work.
"""

from pressline.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
