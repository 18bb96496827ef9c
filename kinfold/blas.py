"""One thread for linear algebra, in the driver as in a task.

A task has one core.  On the driver the pool of threads that a BLAS library starts when NumPy is
imported doesn't survive the fork that starts the JVM: the first larger product or inverse then waits
for it for ever.  Environment variables only count before that import, so the library itself is told.
"""

from __future__ import annotations

import ctypes
import os

#: Names under which BLAS libraries export the setting.
SETTERS = ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads", "MKL_Set_Num_Threads")


def single_thread() -> int:
    """Tells every loaded BLAS library to use one thread; returns how many were told."""
    for name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS"):
        os.environ.setdefault(name, "1")
    import numpy as np  # noqa: F401  (loads the library)

    try:
        with open("/proc/self/maps") as f:
            loaded = {line.split()[-1] for line in f if "blas" in line or "mkl_rt" in line}
    except OSError:
        return 0
    told = 0
    for path in loaded:
        try:
            library = ctypes.CDLL(path)
        except OSError:
            continue
        for name in SETTERS:
            if hasattr(library, name):
                getattr(library, name)(1)
                told += 1
                break
    return told
