"""Array expressions whose work grows linearly with the array or the text.

An array that grows by one element per fold step is copied at every step, and ``substring``
walks a text from its start at every call; ``scan`` and ``TextBlocks`` avoid both.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements gathered in a fold before they are put aside as one chunk.
FOLD_CHUNK = 256
#: Least code points in a block of a text.
TEXT_BLOCK = 4096


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once (a plain alias would be copied to every use)."""
    return F.transform(F.array(value), lambda v: body(v))[0]


def scan(values: Column, state: Column, state_type: str, item_type: str, step: Callable[[Column, Column], Column]) -> Column:
    """The items of a left-to-right pass: ``step(state, value)`` is a struct (state, item)."""
    empty = F.array().cast(f"array<{item_type}>")
    zero = F.struct(state.cast(state_type).alias("state"), F.array().cast(f"array<array<{item_type}>>").alias("done"), empty.alias("cur"))

    def merge(acc: Column, x: Column) -> Column:
        full = F.size(acc["cur"]) >= FOLD_CHUNK
        return let(step(acc["state"], x), lambda r: F.struct(
            r["state"].alias("state"),
            F.when(full, F.array_append(acc["done"], acc["cur"])).otherwise(acc["done"]).alias("done"),
            F.array_append(F.when(full, empty).otherwise(acc["cur"]), r["item"]).alias("cur")))
    return F.aggregate(values, zero, merge, lambda acc: F.flatten(F.array_append(acc["done"], acc["cur"])))


def runs(values: Column, starts: Column) -> Column:
    """The slices of ``values`` that begin at the places ``starts`` (ascending, the first 0)."""
    return F.transform(starts, lambda a, q: F.slice(values, a + 1, F.coalesce(F.get(starts, q + 1), F.size(values)) - a))


class TextBlocks:
    """A text cut into blocks, so that a piece anywhere in it is read from its own block."""

    def __init__(self, text: Column, width: Column, blocks: Column):
        self.length, self._width, self._blocks = F.length(text), width, blocks

    @staticmethod
    def of(text: Column, body: Callable[[TextBlocks], Column]) -> Column:
        """``body`` of the blocks of ``text``; they are wider in longer texts, so both making and reading them stay cheap."""
        def cut(t: Column, w: Column) -> Column:
            return F.transform(F.sequence(F.lit(0), F.floor(F.length(t) / w).cast("int")), lambda k: F.substring(t, k * w + 1, w))
        width = lambda t: F.greatest(F.lit(TEXT_BLOCK), (F.sqrt(F.length(t)) * 16).cast("int"))
        return let(text, lambda t: let(width(t), lambda w: let(cut(t, w), lambda b: body(TextBlocks(t, w, b)))))

    def between(self, a: Column, b: Column) -> Column:
        """Code points [a, b); empty where b <= a."""
        w = self._width
        def piece(first: Column) -> Column:
            last = F.floor((b - 1) / w).cast("int")
            own = F.array_join(F.slice(self._blocks, first + 1, last - first + 1), "")
            return F.when(last == first, F.get(self._blocks, first)).otherwise(own).substr(a - first * w + 1, b - a)
        return F.when(b <= a, F.lit("")).otherwise(let(F.floor(a / w).cast("int"), piece))
