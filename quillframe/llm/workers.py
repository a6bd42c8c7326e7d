"""What runs in Python workers, which Spark uses again for other tasks and queries.

This module is shipped whole, so it holds nothing that belongs to a session.
"""

from __future__ import annotations

import sys
from types import ModuleType


def ship(module_name: str) -> None:
    """Send a module's functions, and those here, to the executors by value; nothing need be installed there."""
    import pyspark.cloudpickle as cloudpickle

    for name in (module_name, __name__):
        cloudpickle.register_pickle_by_value(sys.modules[name])


def worker_state() -> dict:
    """What a worker keeps from task to task. Modules are shipped anew with each task, so it is kept outside of them."""
    return sys.modules.setdefault("quillframe_worker_state", ModuleType("quillframe_worker_state")).__dict__.setdefault("kept", {})


def give_back(all_of_it: bool = False) -> None:
    """Give unused memory back to the system, and with ``all_of_it`` what earlier queries kept."""
    import ctypes

    import pyarrow as pa

    if all_of_it:
        worker_state().clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)
