"""Running and observing streams."""

from tidemark.streaming.observe import ProgressLog, lifecycle_rows, progress_messages
from tidemark.streaming.run import run_available, run_until_stopped

__all__ = [
    "ProgressLog",
    "lifecycle_rows",
    "progress_messages",
    "run_available",
    "run_until_stopped",
]
