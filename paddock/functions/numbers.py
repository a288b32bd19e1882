"""Numbers as text that reads back as the same number."""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Integers are told digit by digit up to 64 bits.
_LEAST, _MOST = -(2**63), 2**63 - 1


def _plain(texts: pa.Array) -> pa.Array:
    """Exponents written out."""
    far = np.flatnonzero(pc.match_substring(texts, "e").to_numpy(zero_copy_only=False))
    if not len(far):
        return texts
    held = texts.to_numpy(zero_copy_only=False)
    for i in far:
        held[i] = format(Decimal(held[i]), "f")
    return pa.array(held, pa.string())


def _untied(texts: pa.Array, x: np.ndarray) -> pa.Array:
    """``texts`` of the 32-bit floats ``x``; one as near as another of its length gives way to the whole number's text.

    A tie ends half a unit beyond the text's last decimal. Of twelve decimals or fewer the shifted float is exact in
    a double; longer ties have more digits than a shortest text.
    """
    point = pc.find_substring(texts, ".").to_numpy(zero_copy_only=False)
    decimals = np.where(point < 0, 0, pc.utf8_length(texts).to_numpy(zero_copy_only=False) - point - 1)
    shifted = np.abs(x) * 10.0 ** np.minimum(decimals, 12)
    tied = np.flatnonzero((decimals <= 12) & (shifted - np.floor(shifted) == 0.5))
    if not len(tied):
        return texts
    held = texts.to_numpy(zero_copy_only=False)
    held[tied] = [f"{v:.{n + 1}f}" for v, n in zip(x[tied].tolist(), decimals[tied].tolist())]
    return pa.array(held, pa.string())


def texts_of(values: pa.Array, untie: bool = False) -> pa.Array:
    """What ``number_text`` says of an array of doubles."""
    x = values.fill_null(np.nan).to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.full(len(x), "null", object)
    finite = np.isfinite(x)
    with np.errstate(over="ignore", invalid="ignore"):
        whole = finite & (x == np.floor(x)) & (np.abs(x) <= 2.0**63)
        single = finite & ~whole & (x.astype(np.float32).astype(np.float64) == x)
    double = finite & ~whole & ~single
    out[whole] = [str(min(max(int(v), _LEAST), _MOST)) for v in x[whole]]
    for rows, kind in ((single, np.float32), (double, np.float64)):
        if rows.any():
            texts = _plain(pa.array(x[rows].astype(kind)).cast(pa.string()))
            out[rows] = (_untied(texts, x[rows]) if untie and kind is np.float32 else texts).to_numpy(zero_copy_only=False)
    return pa.array(out, pa.string())


def number_text(value: Column, untie: bool = False) -> Column:
    """A double as text without exponent: integers as such, else the shortest that reads back as the same 32-bit float where the value is one, else as the same double; ``null`` for missing and infinite values.

    Of a 32-bit float exactly between two shortest texts the one with the even last digit is told; with ``untie``
    neither, but the number with its one more digit.
    """

    @F.arrow_udf("string")
    def told(v: pa.Array) -> pa.Array:
        return texts_of(v, untie)

    return told(value.cast("double"))
