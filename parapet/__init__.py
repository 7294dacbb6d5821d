"""Spark-native auditing of large language-model conversation corpora.

Every operator is a ``Column -> Column`` or ``DataFrame -> DataFrame`` function;
nothing here runs a job on its own except the few places that say so.
"""

import sys

from pyspark import cloudpickle

# Python functions of this package travel to the executors by value, so it need not be
# installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
