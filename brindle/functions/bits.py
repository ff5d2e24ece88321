"""Bit fields of integer words as Column expressions; places count from the lowest bit."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class BitField:
    """``width`` bits from place ``start`` of a word."""

    start: int
    width: int

    def __post_init__(self):
        if self.start < 0 or self.width < 1 or self.start + self.width > 63:
            raise ValueError(f"no field of a word: {self.width} bits from place {self.start}")

    @property
    def mask(self) -> int:
        return ((1 << self.width) - 1) << self.start

    def of(self, word: Column) -> Column:
        """The field's bits where they are, all others zero."""
        return word.bitwiseAND(F.lit(self.mask))

    def read(self, word: Column) -> Column:
        """The field as a number."""
        return F.shiftright(self.of(word), self.start)

    def ones(self, word: Column) -> Column:
        return F.bit_count(self.of(word))

    def fill(self, word: Column) -> Column:
        """The word with all bits of the field set."""
        return word.bitwiseOR(F.lit(self.mask))

    def clear(self, word: Column) -> Column:
        """The word with the field at zero."""
        return word.bitwiseAND(F.lit(~self.mask))

    def flip(self, word: Column) -> Column:
        return word.bitwiseXOR(F.lit(self.mask))

    def write(self, word: Column, value: Column) -> Column:
        """The word with the field set to a number's lowest bits."""
        return self.clear(word).bitwiseOR(self.of(F.shiftleft(value, self.start)))


def nibble(word: Column, i: int) -> Column:
    """The i-th group of four bits."""
    return BitField(4 * i, 4).read(word)
