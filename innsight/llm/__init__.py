"""Corpus operators for preparing training data.

Every module holds one operator with its own general interface; ``queries``
registers one query per operator and ``corpus_pipeline`` (repository top)
chains five of them. Nothing outside this package imports it.

Functions that run in Python workers are pickled by value, so executors need
numpy, pyarrow and the listed libraries but not this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
