"""Spark-native analytics over gridded soil, climate and canopy tables.

A raster is a long table of cells keyed by ``(row, col)``; depth layer, date,
season and model are columns.  Every operator is a pure
``DataFrame -> DataFrame`` transformation unless its docstring says that it
runs jobs (model fitting does).
"""

import sys

from pyspark import cloudpickle

# Python functions travel inside the task closure, so executors need no
# installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
