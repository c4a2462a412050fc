"""Operators of a training-data pipeline over `documents`, `pages` and `benchmark`.

Every module is independent; nothing outside this subpackage imports it.
`eventlens.llm.queries` lists the registered queries and their oracle SQL.
"""

import sys

from pyspark import cloudpickle

# Task functions travel by value, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
