"""pagefold: company-page analytics on Spark DataFrames.

A crawl corpus (``pages``: page_id, url, html) is parsed once into an
element table; every other operator is a DataFrame/SQL transformation
keyed by ``page_id``.
"""

__version__ = "0.1.0"

import sys as _sys

try:  # ship this package's Python functions with each task (no executor install)
    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older pyspark
    pass
