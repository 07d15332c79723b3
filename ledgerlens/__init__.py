"""ledgerlens: sub-ledger analytics written against the Spark DataFrame API.

Every public function takes and returns DataFrames; the work runs as Spark
jobs (scans, joins, aggregates, windows).  Python inside tasks is limited to
the two matrix passes (correlation moments and the Gram/leave-one-out passes
of the trainer), which run through Arrow batches in ``mapInPandas``.
"""

import sys as _sys

try:  # ship the package by value with the few mapInPandas functions
    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle
    pass

__all__ = ["schema"]
