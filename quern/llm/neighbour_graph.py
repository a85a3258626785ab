"""Near-duplicate vectors by NN-descent.

Every vector keeps a list of its nearest known others.  Lists start from the
neighbours in a few sorted orders (signs of random projections) and are refined
round by round: the lists that meet in a vector, forward and reverse, are compared
with each other, as neighbours of neighbours are likely neighbours.  A list whose
last entry is still a link is saturated and may hide more, so it is doubled, up to
``LONGEST``; what a list of that length cannot hold is counted exactly within the
vector's component, by balls (below).  Entries that reach the threshold are confirmed
on the full vectors in double precision and kept as links.  At last a sample is
held against all rows; where recall is below ``RECALL``, more orders are added
and the lists are refined again.

Cost at scale.  Equal vectors are folded into one node first.  Rounds ship vectors
in half precision (its error is bounded by ``SLACK``), and a node meets at most
``MEET`` others by its own list and ``MEET`` by others' lists in a round, so a round
moves a fixed number of rows a node, however many point to one hub; what is left
out of one round is in a list still.  Lists and counts are written after each round.

Balls.  Members of a component that has a pair not known to link are cut into blocks of
``BLOCK`` in a sorted order; a block knows its centre and radius.  Two blocks whose
centres are so near that all their vectors link are counted without being read;
blocks too far for any link are passed over; only the rest are multiplied out,
and they return one count a vector.  No pair of a dense group is ever a row.

Defined results.  Vectors that are null, empty, zero, or hold a null or non-finite
component link with nothing and are kept; so are rows without id, which have no
component.  Rows are vectors of their own even if they share an id: copies of a
row link with each other.  Vectors of different lengths do not link.  Only the id and
vector columns are read; an empty table gives no rows.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .additive_ann import usable
from .components import components
from .scratch import discard, materialize

ORDERS, REACH = 16, 3
SHORTEST, LONGEST = 8, 32
MEET = 8
ROUNDS, SETTLED = 8, 0.01
BLOCK, SALTS = 1024, 16
AUDITED, RECALL, ATTEMPTS = 256, 0.99, 3
#: Twice half precision's unit of rounding, and what single precision may lose in a sum.
SLACK = 2 * 2**-11 + 1e-4

_LISTS = "node long, size int, others array<long>, sims array<float>, fresh array<boolean>"
_FOUND = "node long, others array<long>, sims array<float>"


def _matrix(column: pa.Array) -> np.ndarray:
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _halves(column: pa.Array) -> np.ndarray:
    """Rows of vectors that were packed in half precision."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float16).astype(np.float32).reshape(len(column), -1)


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values))


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, whatever the size of their components."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _units(batches):
    for batch in batches:
        if batch.num_rows:
            x = unit_rows(_matrix(batch.column(2)))
            half = pa.array([r.tobytes() for r in x.astype(np.float16)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), _lists(x.ravel(), np.full(len(x), x.shape[1])), half, batch.column(3)], ["min_id", "weight", "vector", "unit", "half", "node"])


def _sign_codes(x: np.ndarray, order: int) -> np.ndarray:
    """Signs of 62 random projections as one integer, first projection highest."""
    planes = np.random.default_rng(1000 + order).standard_normal((x.shape[1], 62)).astype(np.float32)
    return ((x @ planes > 0) << np.arange(61, -1, -1, dtype=np.int64)).sum(1, dtype=np.int64)


def _ordered(orders: range):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = _halves(batch.column(1))
                for t in orders:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(_sign_codes(x, t)), batch.column(0), batch.column(1)], ["order", "code", "node", "half"])

    return run


def _adjacent(reach: int):
    """Similarities of each row with the ``reach`` rows before it in the same order, given to both."""

    def run(batches):
        order, node, x = np.zeros(0, np.int32), np.zeros(0, np.int64), None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = _halves(batch.column(3))
            old = len(node)
            order = np.concatenate([order, batch.column(0).to_numpy()])
            node = np.concatenate([node, batch.column(2).to_numpy()])
            x = now if x is None else np.concatenate([x, now])
            ones, twos, sims = [], [], []
            for step in range(1, reach + 1):
                late = np.arange(max(old, step), len(node))
                late = late[order[late] == order[late - step]]
                sim = np.einsum("ij,ij->i", x[late], x[late - step])
                ones += [node[late], node[late - step]]
                twos += [node[late - step], node[late]]
                sims += [sim, sim]
            one, two, sim = (np.concatenate(v) for v in (ones, twos, sims))
            by = np.argsort(one, kind="stable")
            owners, counts = np.unique(one, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(owners), _lists(two[by], counts), _lists(sim[by].astype(np.float32), counts)], ["node", "others", "sims"])
            order, node, x = order[-reach:], node[-reach:], x[-reach:]

    return run


def merge_lists(rows: np.ndarray, others: np.ndarray, sims: np.ndarray, known: np.ndarray, sizes: np.ndarray, link: float, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places kept, their rows, sizes after): each row's nearest distinct others, as many as its list holds.

    A row whose list is full of links takes twice as many.  ``known`` entries stand for themselves where they are found again.
    """
    by = np.lexsort((~known, others, rows))
    r, o = rows[by], others[by]
    by = by[np.concatenate([[True], (r[1:] != r[:-1]) | (o[1:] != o[:-1])])] if len(by) else by
    by = by[np.lexsort((others[by], -sims[by], rows[by]))]
    r = rows[by]
    place = np.arange(len(r)) - np.searchsorted(r, r)
    links = np.bincount(r[sims[by] >= link], minlength=len(sizes))
    sizes = sizes.copy()
    while (grow := (links >= sizes) & (sizes < longest)).any():
        sizes[grow] *= 2
    keep = place < sizes[r]
    return by[keep], r[keep], sizes


def _merger(link: float, longest: int):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = batch.column(1).to_numpy()
            counts = pc.list_value_length(batch.column(2)).to_numpy()
            rows = np.repeat(np.arange(batch.num_rows), counts)
            others, sims, known = (pc.list_flatten(batch.column(i)).to_numpy(zero_copy_only=False) for i in (2, 3, 4))
            kept, owner, sizes = merge_lists(rows, others, sims, known.astype(bool), sizes, link, longest)
            counts = np.bincount(owner, minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), _lists(others[kept], counts), _lists(sims[kept], counts), _lists(~known[kept].astype(bool), counts)], ["node", "size", "others", "sims", "fresh"])

    return run


def _meetings(batches, chunk: int = 512):
    """For each group of vectors that met: what each one gains, where it is better than the last of its full list."""
    for batch in batches:
        for start in range(0, batch.num_rows, chunk):
            members = batch.column(0).slice(start, chunk)
            counts = pc.list_value_length(members).to_numpy()
            flat = pc.list_flatten(members)
            node, last, fresh = (flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 2, 3))
            x = _halves(flat.field(1))
            row = np.repeat(np.arange(len(counts)), counts)
            place = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
            table = np.zeros((len(counts), counts.max(), x.shape[1]), np.float32)
            table[row, place] = x
            at = np.full(table.shape[:2], -1)
            at[row, place] = np.arange(len(row))
            sims = table @ table.transpose(0, 2, 1)
            one, two = at[:, :, None], at[:, None, :]
            wanted = (one >= 0) & (two >= 0) & (fresh[one] | fresh[two]) & (node[one] != node[two]) & (sims > last[one])
            g, i, j = np.nonzero(wanted)
            owner = at[g, i]
            gains = np.bincount(owner, minlength=len(node))
            owners = np.flatnonzero(gains)
            if len(owners):
                yield pa.RecordBatch.from_arrays([pa.array(node[owners]), _lists(node[at[g, j]], gains[owners]), _lists(sims[g, i, j], gains[owners])], ["node", "others", "sims"])


def _merged(lists: DataFrame, found: DataFrame, link: float, longest: int) -> DataFrame:
    """Lists with what was found for them."""
    old = lists.select("node", "size", "others", "sims", F.transform("others", lambda _: F.lit(True)).alias("known"))
    new = found.select("node", F.lit(None).cast("int").alias("size"), "others", "sims", F.transform("others", lambda _: F.lit(False)).alias("known"))
    flat = lambda name: F.flatten(F.collect_list(name)).alias(name)
    both = old.union(new).groupBy("node").agg(F.coalesce(F.max("size"), F.lit(SHORTEST)).alias("size"), flat("others"), flat("sims"), flat("known"))
    return both.mapInArrow(_merger(link, longest), _LISTS)


def _seeds(nodes: DataFrame, orders: range) -> DataFrame:
    parts = max(1, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = nodes.select("node", "half").mapInArrow(_ordered(orders), "order int, code long, node long, half binary")
    # The node is in the key, so that a range of equal codes is cut as well.
    return placed.repartitionByRange(parts, "order", "code", "node").sortWithinPartitions("order", "code", "node").mapInArrow(_adjacent(REACH), _FOUND)


def _round(lists: DataFrame, nodes: DataFrame, turn: int) -> DataFrame:
    """(node, others, sims) that neighbours of neighbours bring."""
    last = F.when(F.size("sims") >= F.col("size"), F.try_element_at("sims", F.lit(-1))).otherwise(F.lit(-2.0)).cast("float")
    known = materialize(nodes.select("node", "half").join(lists, "node").withColumn("last", last), "known")
    entries = known.select("node", "half", "last", F.explode(F.arrays_zip("others", "fresh")).alias("e")).select("node", "half", "last", "e.others", "e.fresh")
    chance = F.xxhash64("node", "others", F.lit(turn))
    own = Window.partitionBy("node").orderBy(F.desc("fresh"), chance, "others")
    entries = entries.withColumn("p", F.row_number().over(own)).where(F.col("p") <= MEET)
    reverse = Window.partitionBy("others").orderBy(F.desc("fresh"), chance, "node")
    used = entries.withColumn("p", F.row_number().over(reverse)).where(F.col("p") <= MEET)
    there = used.select(F.col("others").alias("meets"), "node", "half", "last", "fresh")
    back = used.select(F.col("others").alias("node"), F.col("node").alias("meets"), "fresh").join(known.select("node", "half", "last"), "node").select("meets", "node", "half", "last", "fresh")
    itself = known.select(F.col("node").alias("meets"), "node", "half", "last", F.lit(False).alias("fresh"))
    groups = there.union(back).union(itself).groupBy("meets").agg(F.collect_list(F.struct("node", "half", "last", "fresh")).alias("members"))
    return groups.where(F.exists("members", lambda m: m["fresh"])).select("members").mapInArrow(_meetings, _FOUND)


def _refined(lists: DataFrame, nodes: DataFrame, link: float, longest: int) -> DataFrame:
    """Lists after as many rounds as bring new links, or change a share ``SETTLED`` of all entries."""
    for turn in range(ROUNDS):
        after = materialize(_merged(lists, _round(lists, nodes, turn), link, longest), "lists")
        discard(lists)
        lists = after
        entries = lists.select(_full_of_links(link, longest).alias("full"), F.explode(F.arrays_zip("sims", "fresh")).alias("e"))
        gained = F.col("e.fresh") & (F.col("e.sims") >= link) & ~F.col("full")
        seen = entries.agg(F.count("*").alias("n"), F.count_if("e.fresh").alias("fresh"), F.count_if(gained).alias("links")).first()
        if seen.fresh <= SETTLED * seen.n or (turn and not seen.links):
            break
    return lists


def _full_of_links(link: float, longest: int) -> Column:
    """A list of the greatest length that holds links alone: what more there is, only counting can tell."""
    return (F.col("size") >= longest) & (F.size("sims") >= F.col("size")) & (F.try_element_at("sims", F.lit(-1)) >= link)


def _links(lists: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a < b: entries that reach the threshold on full vectors."""
    entries = lists.select("node", F.explode(F.arrays_zip("others", "sims")).alias("e")).where(F.col("e.sims") >= threshold - SLACK)
    pairs = entries.select(F.least("node", "e.others").alias("a"), F.greatest("node", "e.others").alias("b")).distinct()
    ends = lambda end: nodes.select(F.col("node").alias(end), F.col("unit").alias(f"unit_{end}"))
    product = F.aggregate(F.zip_with("unit_a", "unit_b", lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return pairs.join(ends("a"), "a").join(ends("b"), "b").where(product >= threshold).select("a", "b")


def _blocks(size: int):
    """Rows of a component in their order, packed: centre, radius (rounded up), nodes, weights, vectors."""

    def pack(part: pa.Table) -> pa.RecordBatch:
        x = _matrix(part["unit"].combine_chunks())
        middle = x.sum(0)
        long = np.sqrt((middle * middle).sum())
        middle = middle / long if long > 1e-9 else x[0]
        radius = float(np.arccos(np.clip(x @ middle, -1, 1)).max()) + 1e-6
        weights = part["weight"].to_numpy()
        columns = [part["component"].combine_chunks()[:1], part["node"].combine_chunks()[:1], _lists(middle, np.array([len(middle)])), pa.array([radius]), pa.array([int(weights.sum())])]
        columns += [pa.array([a.tobytes()], pa.binary()) for a in (part["node"].to_numpy(), weights, x)]
        return pa.RecordBatch.from_arrays(columns, ["component", "block", "centre", "radius", "weight", "nodes", "weights", "vectors"])

    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            component = held["component"].to_numpy()
            cuts = np.flatnonzero(component[1:] != component[:-1]) + 1
            starts = np.concatenate([[0], cuts]) if len(component) else cuts
            ends = np.concatenate([cuts, [len(component)]]) if len(component) else cuts
            for a, b in zip(starts, ends, strict=True):
                while b - a >= size or (b < len(component) and b > a):
                    yield pack(held.slice(a, min(size, b - a)))
                    a = min(a + size, b)
            if len(component):
                held = held.slice(a)
        if held is not None and held.num_rows:
            yield pack(held)

    return run


def _counter(threshold: float):
    """Weights that link with each vector of one block among those of another."""

    def run(batches):
        for batch in batches:
            for nodes, left, weights, right in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                nodes, weights = np.frombuffer(nodes, np.int64), np.frombuffer(weights, np.int64)
                left, right = np.frombuffer(left).reshape(len(nodes), -1), np.frombuffer(right).reshape(len(weights), -1)
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array((left @ right.T >= threshold) @ weights)], ["node", "linked"])

    return run


def dense_counts(members: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """(node, linked): weights of all nodes of the same component that link with a node, itself included.

    ``members``: component, node, weight, unit, code (what rows are sorted by).
    """
    parts = max(1, int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = members.repartitionByRange(parts, "component", "code", "node").sortWithinPartitions("component", "code", "node")
    blocks = placed.select("component", "node", "weight", "unit").mapInArrow(_blocks(block), "component long, block long, centre array<double>, radius double, weight long, nodes binary, weights binary, vectors binary")
    blocks = materialize(blocks, "blocks")
    side = lambda s: blocks.select("component", *(F.col(c).alias(f"{c}_{s}") for c in ("block", "centre", "radius", "weight")))
    one = side("a").withColumn("salt", F.pmod(F.xxhash64("block_a"), F.lit(SALTS)))
    two = side("b").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    product = F.aggregate(F.zip_with("centre_a", "centre_b", lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    apart = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), product)))
    widest = float(np.arccos(threshold))
    reach = F.col("radius_a") + F.col("radius_b") + 1e-6
    pairs = one.join(two, ["component", "salt"]).withColumn("apart", apart).where(F.col("apart") - reach <= widest)
    pairs = materialize(pairs.select("block_a", "block_b", "weight_b", (F.col("apart") + reach <= widest).alias("whole")), "ballpairs")
    sums = pairs.where("whole").groupBy("block_a").agg(F.sum("weight_b").alias("whole"))
    # A block's nodes, each with what whole blocks bring.
    nodes_of = blocks.join(sums, blocks["block"] == sums["block_a"]).select("nodes", "whole").mapInArrow(_spread, "node long, linked long")
    left = blocks.select(F.col("block").alias("block_a"), "nodes", F.col("vectors").alias("left"))
    right = blocks.select(F.col("block").alias("block_b"), "weights", F.col("vectors").alias("right"))
    open_pairs = pairs.where("not whole").join(left, "block_a").join(right, "block_b").select("nodes", "left", "weights", "right")
    counted = open_pairs.mapInArrow(_counter(threshold), "node long, linked long")
    return nodes_of.union(counted).groupBy("node").agg(F.sum("linked").alias("linked"))


def _spread(batches):
    for batch in batches:
        for nodes, whole in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            nodes = np.frombuffer(nodes, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(np.full(len(nodes), whole))], ["node", "linked"])


def _coder(batches):
    for batch in batches:
        if batch.num_rows:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_sign_codes(_halves(batch.column(1)), 0))], ["node", "code"])


def audit(counts: DataFrame, nodes: DataFrame, threshold: float, sample: int = AUDITED) -> float:
    """Share of the links of a sample that ``counts`` (node, weight, linked) knows; half of the sample has links as far as known."""
    chance = F.xxhash64("node", F.lit("audit"))
    known = counts.where("linked > weight").orderBy(chance, "node").limit(sample // 2)
    asked = known.union(counts.orderBy(chance, "node").limit(sample - sample // 2)).distinct().join(nodes.select("node", "unit"), "node").toArrow()
    if not asked.num_rows:
        return 1.0
    ids, units = asked["node"].to_numpy(), _matrix(asked["unit"].combine_chunks())

    def run(batches):
        total = np.zeros(len(ids), np.int64)
        for batch in batches:
            if batch.num_rows:
                total += (units @ _matrix(batch.column(0)).T >= threshold) @ batch.column(1).to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], ["node", "true"])

    true = nodes.select("unit", "weight").mapInArrow(run, "node long, true long").groupBy("node").agg(F.sum("true").alias("true")).toPandas()
    both = true.merge(asked.select(["node", "weight", "linked"]).to_pandas(), on="node")
    links = (both["true"] - both["weight"]).sum()
    return float((both["linked"] - both["weight"]).sum() / links) if links else 1.0


def _linked(nodes: DataFrame, threshold: float, longest: int) -> DataFrame:
    """(node, component, linked): nodes of one length, their components, and the weight that links with each, itself included."""
    link = threshold - SLACK
    lists = nodes.select("node", F.lit(SHORTEST).alias("size"), F.array().cast("array<long>").alias("others"), F.array().cast("array<float>").alias("sims"), F.array().cast("array<boolean>").alias("fresh"))
    for attempt in range(ATTEMPTS):
        orders = range(attempt * ORDERS, (attempt + 1) * ORDERS)
        lists = materialize(_merged(lists, _seeds(nodes, orders), link, longest), "lists")
        lists = _refined(lists, nodes, link, longest)
        links = materialize(_links(lists, nodes, threshold), "links")
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        weights = nodes.select(F.col("node").alias("b"), "weight")
        labels = components(links, "a", "b").withColumnRenamed("vertex", "node")
        counted = both.join(weights, "b").groupBy(F.col("a").alias("node")).agg(F.sum("weight").alias("more"), F.count("*").alias("ends"))
        known = nodes.select("node", "weight", "min_id").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node")).join(counted, "node", "left")
        known = materialize(known.withColumn("linked", F.col("weight") + F.coalesce("more", F.lit(0))), "counted")
        # Where not all pairs of a component are known links, its members are counted again, pair by pair or by balls.
        whole = known.groupBy("component").agg(F.count("*").alias("n"), F.sum(F.coalesce("ends", F.lit(0))).alias("ends"))
        crowded = whole.where(F.col("ends") < F.col("n") * (F.col("n") - 1)).select("component")
        members = known.join(crowded, "component", "left_semi").select("component", "node").join(nodes.select("node", "weight", "unit", "half"), "node")
        members = materialize(members, "members")
        if not members.isEmpty():
            codes = members.select("node", "half").mapInArrow(_coder, "node long, code long")
            exact = dense_counts(members.join(codes, "node"), threshold).withColumnRenamed("linked", "exact")
            known = materialize(known.join(exact, "node", "left").withColumn("linked", F.coalesce("exact", "linked")), "counted")
        recall = audit(known.select("node", "weight", "linked"), nodes, threshold)
        discard(links, members)
        if recall >= RECALL:
            break
    else:
        warnings.warn(f"links found with a recall of {recall:.4f} on a sample", stacklevel=2)
    return known.select("node", "component", "min_id", "linked")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, longest: int = LONGEST) -> DataFrame:
    """(id, n_links, component_id, kept), one row per row of ``vectors``: links are cosines of ``threshold`` or more."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    takes: Column = F.col("id").isNotNull() & usable(F.col("vector"))
    rows = materialize(rows.withColumn("takes", F.coalesce(takes, F.lit(False))), "rows")
    folded = rows.where("takes").groupBy("vector").agg(F.min("id").alias("min_id"), F.count("*").alias("weight"))
    folded = materialize(folded.withColumn("node", F.monotonically_increasing_id()), "folded")
    known = None
    # One row a length; a table of vectors has one length, or few.
    for length in folded.select(F.size("vector").alias("width")).distinct().orderBy("width").collect():
        of = folded.where(F.size("vector") == length.width).select("min_id", "weight", "vector", "node")
        units = of.mapInArrow(_units, "min_id long, weight long, vector array<double>, unit array<double>, half binary, node long")
        part = _linked(materialize(units, "nodes"), threshold, longest)
        known = part if known is None else known.union(part)
    alone = rows.where("not takes").select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    if known is None:
        return alone
    least = known.groupBy("component").agg(F.min("min_id").alias("component_id"))
    named = materialize(known.join(least, "component").select("node", "linked", "component_id").join(folded.select("node", "vector"), "node"), "named")
    found = rows.where("takes").select("id", "vector").join(named, "vector")
    found = found.select(F.col("id").alias("vec_id"), (F.col("linked") - 1).alias("n_links"), "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
    return found.union(alone)
