"""Operators for preparing training data; nothing else in the library imports this subpackage.

Functions that run inside tasks are sent to the executors by value, so a cluster needs no
installed copy of this package.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
