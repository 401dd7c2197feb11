"""Learning-dialogue analytics, written for Spark DataFrames.

Sub-packages: ``functions`` (column expressions), ``operators`` (DataFrame to
DataFrame), ``sources`` (scans and sinks), ``plans`` (whole queries with their
DuckDB oracles), ``streaming`` and ``llm`` (corpus preparation, optional: no
other sub-package imports it).
"""

import sys

from pyspark import cloudpickle

# Executors need not have this package installed: what is defined here travels
# with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
