"""millrace: a Spark-native feed of training shards.

Labelled samples are numbered, cut into fixed-size shards, published whole, read back as a table or
as an ordered stream, scored and trained on, and the feed's own logs are turned into the figures that
say where the time went.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

from millrace.config import FeedConfig

# The few functions that run in tasks travel with the task, so workers need no copy of the package.
register_pickle_by_value(sys.modules[__name__])

__all__ = ["FeedConfig"]
