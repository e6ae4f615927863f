"""Several small columns that travel through a shuffle as one long."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F
from pyspark.sql.types import DataType


class Field:
    """A column of which most values are whole numbers of `bits` bits: `code` gives the number, `value` the column back."""

    def __init__(self, name: str, bits: int, code: Callable[[Column], Column] = lambda c: c, value: Callable[[Column], Column] = lambda n: n):
        self.name, self.bits, self.code, self.value = name, bits, code, value


def counted(name: str, bits: int, kind: DataType) -> Field:
    """Whole numbers from zero on, and null."""
    return Field(name, bits, lambda c: F.coalesce(F.when(c >= 0, c.cast("long") + 1), F.lit(0)), lambda n: F.when(n > 0, n - 1).cast(kind))


def dated(name: str, bits: int, kind: DataType) -> Field:
    """Days since 1970, as a date or as the midnight a day begins with."""
    return Field(name, bits, lambda c: F.unix_date(c.cast("date")), lambda n: F.date_from_unix_date(n.cast("int")).cast(kind))


def priced(name: str, bits: int, kind: DataType) -> Field:
    """Amounts of two decimals."""
    return Field(name, bits, lambda c: F.when((c >= 0) & (c < 2**bits), F.rint(c.cast("double") * 100).cast("long")), lambda n: (n.cast("double") / 100).cast(kind))


class Packing:
    """`fields` side by side in one long, the first highest, where each of a row's values comes back from its bits as it was.

    Rows with a value that does not, as a time of day or a number too large, have no long and carry all their
    columns beside it, so nothing depends on what fits.
    """

    def __init__(self, *fields: Field, packed: str = "packed", odd: str = "odd"):
        assert sum(f.bits for f in fields) < 64
        self.fields, self.names = fields, (packed, odd)

    def columns(self) -> tuple[Column, Column]:
        """The long and the columns beside it, of which one is null."""
        fits, whole = F.lit(True), F.lit(0).cast("long")
        for f in self.fields:
            code = f.code(F.col(f.name)).cast("long")
            fits = fits & F.coalesce(code.between(0, 2**f.bits - 1), F.lit(False)) & f.value(code).eqNullSafe(F.col(f.name))
            whole = F.shiftleft(whole, f.bits).bitwiseOR(code)
        return F.when(fits, whole).alias(self.names[0]), F.when(~fits, F.struct(*[f.name for f in self.fields])).alias(self.names[1])

    def value(self, name: str) -> Column:
        """A column as it was."""
        at = next(i for i, f in enumerate(self.fields) if f.name == name)
        packed, odd, shift = F.col(self.names[0]), F.col(self.names[1]), sum(f.bits for f in self.fields[at + 1 :])
        code = F.shiftright(packed, shift).bitwiseAND(F.lit(2 ** self.fields[at].bits - 1).cast("long"))
        return F.when(packed.isNull(), odd[name]).otherwise(self.fields[at].value(code))

    def values(self) -> list[Column]:
        return [self.value(f.name).alias(f.name) for f in self.fields]
