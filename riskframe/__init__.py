"""riskframe: Spark-native risk scoring, evaluation, explanation, usage
aggregates and document retrieval.

Every operator is a ``DataFrame -> DataFrame`` function (usable with
``df.transform``); ``fit_*`` functions return small statistics DataFrames
(one row per column or per category) that later transforms read back as
literals or through a size-checked broadcast.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions that run in Python workers travel with their code, so executors
# need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
