"""folioscope: text search, corpus analytics and crawl bookkeeping as Spark DataFrame operators."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Functions that run in tasks travel with the job: executors need not have this package installed.
register_pickle_by_value(sys.modules[__name__])
