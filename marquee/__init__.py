"""marquee: ticketed-venue analytics on Spark.

Operators are functions from DataFrames (with venue column names) to a
DataFrame.  Bindings in :mod:`marquee.plans` map concrete tables onto those
column roles: the 12 venue tables, or the star-schema test tables.
"""

import sys as _sys

try:  # Ship marquee's own functions to Python workers by value, so executors
    # need no installed copy of the package (``--py-files`` works as well).
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle
    pass
