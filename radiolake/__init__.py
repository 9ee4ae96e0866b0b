"""Spark operators for mobile-network KPI, radio-counter and signalling data.

Every operator takes DataFrames and returns a DataFrame; nothing runs until the
caller asks for rows.  ``functions`` holds column expressions and the ordered
(time-sliced) building blocks, ``operators`` the analytics, ``sources`` readers
and writers, ``streaming`` the Structured Streaming forms and ``plans`` the
registered queries over the driver tables.
"""

import sys

from pyspark import cloudpickle

# Helpers that run inside tasks travel with the plan, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
