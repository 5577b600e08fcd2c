"""Event-impact analytics on Spark: DataFrames in, DataFrames out."""

from __future__ import annotations

import importlib

_PUBLIC = {
    "build_event_feature_frame": "operators.features",
    "build_sequence_batch": "operators.features",
    "iter_task_frames": "operators.labels",
    "evaluate_predictions": "operators.metrics",
    "train_reference_model": "operators.train",
    "load_event_feature_frame": "sources.io",
}
__all__ = list(_PUBLIC)


def __getattr__(name: str):
    """The public functions, imported when asked for."""
    if name not in _PUBLIC:
        raise AttributeError(name)
    return getattr(importlib.import_module(f"{__name__}.{_PUBLIC[name]}"), name)
