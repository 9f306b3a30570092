"""The few element-wise operations that formulas need, for numpy arrays and for Columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F


class NumpyOps:
    sqrt = staticmethod(np.sqrt)
    abs = staticmethod(np.abs)
    exp = staticmethod(np.exp)
    log1p = staticmethod(np.log1p)
    sign = staticmethod(np.sign)
    maximum = staticmethod(np.maximum)
    where = staticmethod(np.where)
    ratio = staticmethod(np.divide)


def _column(value):
    return F.lit(value) if isinstance(value, (int, float)) else value


class ColumnOps:
    sqrt = staticmethod(F.sqrt)
    abs = staticmethod(F.abs)
    exp = staticmethod(F.exp)
    log1p = staticmethod(F.log1p)
    sign = staticmethod(F.signum)

    @staticmethod
    def maximum(a, b):
        return F.greatest(_column(a), _column(b))

    @staticmethod
    def where(condition, a, b):
        return F.when(condition, _column(a)).otherwise(_column(b))

    @staticmethod
    def ratio(a, b):
        """a / b where 0/0 is NaN instead of an ANSI error."""
        return F.coalesce(F.try_divide(_column(a), _column(b)), F.lit(float("nan")))
