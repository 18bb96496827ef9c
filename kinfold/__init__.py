"""A PySpark engine for genome-scale association data."""

from kinfold.blas import single_thread as _single_thread

_single_thread()
