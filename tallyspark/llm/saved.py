"""Tables written between jobs, in the folder that all executors share."""

from __future__ import annotations

from ..sources.scratch import clear, drop, shared_folder
from ..sources.scratch import written as saved

__all__ = ["clear", "drop", "saved", "shared_folder"]
