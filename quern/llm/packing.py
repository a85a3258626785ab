"""Variable-capacity best-fit packing of token sequences into training sequences.

Sequences may have any of several permitted lengths.  Items go, longest first,
into the open bin that they leave least room in.  Where none fits, a bin is
opened at the length of least cost per token that it can be expected to hold:
cost(c) / (own tokens + what the shorter items still waiting can fill).  When all
are placed, each bin is downsized to the shortest permitted length that holds its
contents.  A document longer than the longest length is cut into full sequences,
and its rest is packed like any item; no token is lost or repeated.

Cost at scale.  Tokens are counted in the partitions of the scan, and ids and lengths are
written; texts go no further.  That small table is dealt to one partition for about each
``RUN_ITEMS`` documents, and each task packs what it reads in runs of that many
items, so a task holds no more and a lost one is repeated alone.
What this gives away against one global packing is the last open bins of each run.  A best fit is found in a bit set of the rooms that occur.

Defined results.  Empty and null texts have no token and are in no bin.  Rows are
packed each on its own, whatever their ids.  Only the id and length are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exprs import WORD
from .scratch import materialize

CAPACITIES = (512, 1024, 2048, 4096)
RUN_ITEMS = 20_000
SCHEMA = "bin_id long, capacity int, used int, n_pieces int, doc_ids array<long>, starts array<long>, lengths array<int>"


def sequence_cost(capacity: int) -> float:
    """Time of one training sequence: linear in its length, with a share that grows with the square (attention)."""
    return capacity * (1 + capacity / 16384) + 32


def pack_items(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES, cost: Callable[[int], float] = sequence_cost) -> list[tuple[int, list[int]]]:
    """(capacity, item numbers) of each bin; every item must fit the largest capacity."""
    sizes = sorted(capacities)
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    waiting = sum(lengths)
    content: list[list[int]] = []
    used: list[int] = []
    by_room: dict[int, list[int]] = {}
    rooms = 0
    for i in order:
        length = lengths[i]
        waiting -= length
        fitting = rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            which = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room = min((c for c in sizes if c >= length), key=lambda c: (cost(c) / (length + min(c - length, waiting)), c))
            which = len(content)
            content.append([])
            used.append(0)
        content[which].append(i)
        used[which] += length
        left = room - length
        if left:
            by_room.setdefault(left, []).append(which)
            rooms |= 1 << left
    return [(next(c for c in sizes if c >= u), items) for u, items in zip(used, content, strict=True)]


def _pieces(length: int, longest: int) -> Iterator[tuple[int, int]]:
    for start in range(0, length, longest):
        yield start, min(longest, length - start)


def _packer(capacities: tuple[int, ...], run_items: int, cost: Callable[[int], float]):
    longest = max(capacities)

    def run(batches):
        number = TaskContext.get().partitionId() << 40
        ids: list[int | None] = []
        starts: list[int] = []
        lengths: list[int] = []

        def emit():
            nonlocal number
            rows = []
            for capacity, items in pack_items(lengths, capacities, cost):
                rows.append((number, capacity, sum(lengths[i] for i in items), len(items), [ids[i] for i in items], [starts[i] for i in items], [lengths[i] for i in items]))
                number += 1
            ids.clear(), starts.clear(), lengths.clear()
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32())]
            names = ["bin_id", "capacity", "used", "n_pieces", "doc_ids", "starts", "lengths"]
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds[c]) for c in range(7)], names)

        for batch in batches:
            for doc, length in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for start, size in _pieces(length, longest):
                    ids.append(doc)
                    starts.append(start)
                    lengths.append(size)
                    if len(ids) >= run_items:
                        yield emit()
        if ids:
            yield emit()

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: Column | None = None, capacities: tuple[int, ...] = CAPACITIES, run_items: int = RUN_ITEMS, cost: Callable[[int], float] = sequence_cost) -> DataFrame:
    """One row a bin: its length, what it uses, and its pieces as (document, first token, tokens).

    A document's tokens are its words, or as many as ``length`` says.
    """
    length = F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)) if length is None else length
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(length, F.lit(0)).cast("long").alias("length"))
    # Counted first, so that the work on texts keeps the tasks of the scan, and only two numbers a document move.
    own = materialize(own, "lengths")
    own = own.repartition(max(1, -(-own.count() // run_items)))
    return own.mapInArrow(_packer(tuple(capacities), run_items, cost), SCHEMA)
