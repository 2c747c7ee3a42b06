"""Half-even rounding on the true binary value, which no built-in function gives."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(values: np.ndarray, digits: int) -> np.ndarray:
    """round(x, digits) of each value. Scaled numbers are only trusted where they aren't close to a half or too large."""
    scale = 10.0**digits
    with np.errstate(all="ignore"):
        scaled = values * scale
        out = np.rint(scaled) / scale
        off = np.abs(np.abs(scaled - np.trunc(scaled)) - 0.5)
    unsure = np.flatnonzero(np.isfinite(values) & ((off < 1e-6) | (np.abs(scaled) > 2**40)))
    out[unsure] = [round(x, digits) for x in values[unsure].tolist()]
    return np.where(np.isfinite(values), out, values)


def _rounded(values: pa.Array, digits: int) -> pa.Array:
    plain = values.to_numpy(zero_copy_only=False).astype(np.float64)
    return pa.array(rounded(plain, digits), pa.float64(), mask=np.asarray(values.is_null()))


def py_round(value: Column, digits: int) -> Column:
    """round(value, digits) as a double; 2.675 gives 2.67."""

    @F.arrow_udf("double")
    def run(values: pa.Array) -> pa.Array:
        return _rounded(values, digits)

    return run(value.cast("double"))


def py_rounds(values: dict[str, Column], digits: int) -> Column:
    """A struct of all the values, rounded by one worker."""
    names = list(values)

    @F.arrow_udf("struct<" + ", ".join(f"{n}: double" for n in names) + ">")
    def run(*columns: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays([_rounded(c, digits) for c in columns], names)

    return run(*(v.cast("double") for v in values.values()))
