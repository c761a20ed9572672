"""Operators of a training-data pipeline over document, page and conversation tables.

Helpers run inside tasks, so the package travels with them; executors need no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
