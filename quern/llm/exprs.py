"""Column expressions that several operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Space and 0x09-0x0D.
SPACE_CHARS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold(text: Column) -> Column:
    """A-Z to lower case, and nothing else."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def hash_pair(value: Column) -> tuple[Column, Column]:
    """128 bits as two longs."""
    return F.xxhash64(value), F.xxhash64(F.lit(1), value)


def running(values: Column, start: Column, step: Callable[[Column, Column], Column]) -> Column:
    """For each item, ``step`` folded over all items before it, from ``start``; one more for all items.

    ``step`` is associative and ``start`` its neutral item.  Folds go block by block, of the square root of the array's length each, so that no item folds over all others and
    nothing is copied as often as there are items.
    """

    def over(block: Column) -> Column:
        count = F.size(values)
        blocks = F.sequence(F.lit(0), F.floor(count / block).cast("int"))
        part = lambda i, n: F.slice(values, i * block + 1, n)
        fold_all = lambda xs: F.aggregate(xs, start, step)

        def with_sums(sums: Column) -> Column:
            def with_before(before: Column) -> Column:
                at = lambda i: step(F.get(before, F.floor(i / block).cast("int")), fold_all(part(F.floor(i / block).cast("int"), i % block)))
                return F.transform(F.sequence(F.lit(0), count), at)

            return let(F.transform(blocks, lambda i: fold_all(F.slice(sums, F.lit(1), i))), with_before)

        return let(F.transform(blocks, lambda i: fold_all(part(i, block))), with_sums)

    return let(F.ceil(F.sqrt(F.size(values) + 1)).cast("int"), over)


PARTS = 1024


def parted(text: Column) -> Column:
    """The text in parts of ``PARTS`` code points, for ``between``."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PARTS}}}"), F.lit(0))


def between(parts: Column, start: Column, end: Column) -> Column:
    """Code points start to end of a parted text, without a walk from its beginning."""
    first = F.floor(start / PARTS).cast("int")
    piece = F.array_join(F.slice(parts, first + 1, F.floor(end / PARTS).cast("int") - first + 1), "")
    return F.when(end > start, F.substring(piece, start % PARTS + 1, end - start)).otherwise("")
