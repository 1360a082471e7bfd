"""Scores of a rule: compression ratio, compression capacity and information gain.

``pos`` counts head facts that a rule newly entails, ``all`` what it entails without the
facts that were entailed before, ``length`` its size.  Each score exists as a Python
function, for rules on the driver, and as a column expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F


class Metric(Enum):
    RATIO = "tau"
    CAPACITY = "delta"
    GAIN = "h"
    TOTAL_GAIN = "H"


@dataclass(frozen=True)
class Eval:
    pos: float
    all: float
    length: int
    before: float = 0.0  # the sum of gains of the rules that led here
    step: float = 0.0

    @property
    def neg(self) -> float:
        return self.all - self.pos

    @property
    def tau(self) -> float:
        total = self.all + self.length
        return self.pos / total if total else 0.0

    @property
    def delta(self) -> float:
        return self.pos - self.neg - self.length

    @property
    def gain(self) -> float:
        return self.before + self.step

    @property
    def useful(self) -> bool:
        return self.delta > 0

    def value(self, metric: Metric, cumulated: bool = True) -> float:
        """The score; ``h`` is cumulated unless asked for by step."""
        if metric is Metric.RATIO:
            return self.tau
        if metric is Metric.CAPACITY:
            return self.delta
        return self.gain if metric is Metric.TOTAL_GAIN or cumulated else self.step


def evaluation(pos: float, total: float, length: int, parent: Eval | None = None) -> Eval:
    """An Eval whose gain continues that of ``parent``."""
    step = 0.0
    if pos > 0:
        step = pos * math.log(pos / total)
        if parent is not None and parent.pos > 0:
            step = pos * (math.log(pos / total) - math.log(parent.pos / parent.all))
    return Eval(pos, total, length, parent.gain if parent else 0.0, step)


def tau(pos: Column, total: Column, length: Column) -> Column:
    return F.when(total + length == 0, F.lit(0.0)).otherwise(pos / (total + length))


def delta(pos: Column, total: Column, length: Column) -> Column:
    return pos - (total - pos) - length


def first_gain(pos: Column, total: Column) -> Column:
    """The gain of a rule without a parent."""
    return F.when(pos > 0, pos * F.log(pos / total)).otherwise(F.lit(0.0))
