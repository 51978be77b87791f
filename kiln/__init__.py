"""kiln: a Spark-native toolkit that takes a table from raw to modelled.

Every operator is a *fit* (one distributed aggregation returning a small
set of statistics) followed by an *apply* (a lazy projection or filter).
Operators compose through a declarative list of steps (``kiln.plans``).
"""

from kiln.session import get_spark, ensure_checkpoint_dir

__all__ = ["get_spark", "ensure_checkpoint_dir"]
