"""Operators for training-data pipelines. Nothing outside this subpackage imports it."""

from __future__ import annotations

import sys

from pyspark import cloudpickle

# functions of this subpackage that run on executors are shipped by value: workers need no copy of it
cloudpickle.register_pickle_by_value(sys.modules[__name__])
