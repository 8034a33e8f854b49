"""Heads that reduce a window of vectors to one vector.

Each head has a column form for windows held as ARRAY<ARRAY<DOUBLE>> and an array form used inside
the scoring tasks, where a batch of windows is one (windows, steps, width) array.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from netseq.functions.vectors import doubles, dot, mean_over_time


class Head:
    """Base class. ``before_*`` may extend the window ahead of the sequence model."""

    name = "Head"

    @property
    def parameters(self) -> dict:
        return {}

    def model_shape(self, steps: int, width: int) -> tuple[int, int]:
        """Window shape the sequence model sees."""
        return steps, width

    def output_width(self, steps: int, width: int) -> int:
        raise NotImplementedError

    def before_column(self, window: Column, steps: int, width: int) -> Column:
        return window

    def before_array(self, windows: np.ndarray) -> np.ndarray:
        return windows

    def column(self, window: Column, steps: int, width: int) -> Column:
        raise NotImplementedError

    def array(self, windows: np.ndarray) -> np.ndarray:
        raise NotImplementedError


class FlattenHead(Head):
    """All steps one after the other."""

    name = "Flatten"

    def output_width(self, steps: int, width: int) -> int:
        return steps * width

    def column(self, window: Column, steps: int, width: int) -> Column:
        return F.flatten(window)

    def array(self, windows: np.ndarray) -> np.ndarray:
        return windows.reshape(len(windows), -1)


@dataclass(frozen=True)
class FeaturewiseHead(Head):
    """One linear unit shared by all steps: a number per step; ``project`` leaves out the bias."""

    weights: Sequence[float]
    bias: float = 0.0
    project: bool = False

    @property
    def name(self) -> str:
        return "Featurewise Embed - " + ("Projection" if self.project else "Dense")

    @property
    def parameters(self) -> dict:
        return {"project": self.project}

    @property
    def _offset(self) -> float:
        return 0.0 if self.project else float(self.bias)

    def output_width(self, steps: int, width: int) -> int:
        return steps

    def column(self, window: Column, steps: int, width: int) -> Column:
        return F.transform(window, lambda v: dot(v, self.weights, self._offset))

    def array(self, windows: np.ndarray) -> np.ndarray:
        return windows @ np.asarray(self.weights, dtype=windows.dtype) + self._offset


class AverageHead(Head):
    """Mean over time of each dimension."""

    name = "Global Average Pooling"

    def output_width(self, steps: int, width: int) -> int:
        return width

    def column(self, window: Column, steps: int, width: int) -> Column:
        return mean_over_time(window, width)

    def array(self, windows: np.ndarray) -> np.ndarray:
        return windows.mean(axis=1)


class LastHead(Head):
    """The last step, which is the flow the window is labelled by."""

    name = "Last Token"

    def output_width(self, steps: int, width: int) -> int:
        return width

    def column(self, window: Column, steps: int, width: int) -> Column:
        return F.element_at(window, -1)

    def array(self, windows: np.ndarray) -> np.ndarray:
        return windows[:, -1, :]


class ClsHead(LastHead):
    """Appends a zero step and an indicator dimension that is 1 on that step only, then takes it."""

    name = "CLS Token"

    def model_shape(self, steps: int, width: int) -> tuple[int, int]:
        return steps + 1, width + 1

    def output_width(self, steps: int, width: int) -> int:
        return width

    def before_column(self, window: Column, steps: int, width: int) -> Column:
        marked = F.transform(window, lambda v: F.concat(v, doubles([0.0])))
        return F.concat(marked, F.array(doubles([0.0] * width + [1.0])))

    def before_array(self, windows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(windows), windows.shape[1] + 1, windows.shape[2] + 1), dtype=windows.dtype)
        out[:, :-1, :-1] = windows
        out[:, -1, -1] = 1.0
        return out
