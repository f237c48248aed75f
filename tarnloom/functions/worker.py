"""Objects that a Python worker keeps between tasks."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable
from typing import Any

_NAME = "_tarnloom_worker_cache"


def kept(key: Any, make: Callable[[], Any]) -> Any:
    """``make()`` once per worker process and ``key``.  Functions travel by value
    and get new globals in every task; this module object outlives them."""
    held = sys.modules.setdefault(_NAME, types.ModuleType(_NAME)).__dict__.setdefault("held", {})
    if key not in held:
        held[key] = make()
    return held[key]
