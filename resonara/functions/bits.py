"""256-bit shift fingerprints as eight words of 32 bits in BIGINT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BIN_C, BITS, WORD = 200, 256, 32


def bin_of(shift_c: Column) -> Column:
    """Bin of a shift; null outside the 256 bins."""
    return F.when((shift_c >= 0) & (shift_c < BIN_C * BITS), F.floor(shift_c / BIN_C).cast("int"))


def words(bins: Column) -> Column:
    """Eight words with the bits of an array of bins; nulls are ignored."""

    def word(w: Column) -> Column:
        inside = F.filter(bins, lambda b: b.isNotNull() & (F.floor(b / WORD) == w))
        return F.aggregate(inside, F.lit(0).cast("bigint"), lambda acc, b: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), (b % WORD).cast("int"))))

    return F.transform(F.sequence(F.lit(0), F.lit(BITS // WORD - 1)), word)


def fingerprint(shifts_c: Column) -> Column:
    """Fingerprint of an array of shifts."""
    return words(F.transform(shifts_c, bin_of))


def expanded(shifts_c: Column, bins: int = 1) -> Column:
    """Fingerprint with ``bins`` neighbours set on each side, without wrapping."""
    near = lambda s: F.transform(F.sequence(F.lit(-bins), F.lit(bins)), lambda d: F.when(bin_of(s).isNotNull(), F.least(F.greatest(bin_of(s) + d, F.lit(0)), F.lit(BITS - 1))))
    return words(F.flatten(F.transform(shifts_c, near)))


def contained(inner: Column, outer: Column) -> Column:
    """Whether all bits of ``inner`` are set in ``outer``; eight ANDs that stay in generated code."""
    out = None
    for w in range(BITS // WORD):
        same = inner[w].bitwiseAND(outer[w]) == inner[w]
        out = same if out is None else out & same
    return out
