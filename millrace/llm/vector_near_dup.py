"""Near-duplicate vectors of one label by a subspace pigeonhole join.

For unit vectors a cosine of t is a squared distance of 2 - 2 * t. Vectors are scaled to length 1, rotated, and split into blocks of
eight coordinates. If a pair is within the whole budget, then in at least one block it is within that block's share of
it, in proportion to the block's coordinates. So each block is joined by range on its own, and the union is verified.

1. Equal vectors of one label are one class. A class is known by a digest of 16 bytes; it is rotated once, and what is stored decides
   everything that follows, so all tasks agree about each pair.
2. A node is one block of one label. One with more than ``node_limit`` members is cut along the block's first coordinate into cells of
   twice the reach, then along the second, and so on; who lies within reach of a cell's lower border goes to the cell below as well. A pair
   meets in just one cell: not where both are such guests. What is still large after the last coordinate are copies; they are
   dealt in all pairs of sub-blocks, where only members of different sub-blocks, or of one with itself, are compared.
3. In a node, members without a partner in the block drop out; only the others fetch their whole vectors. A pair is verified in the first
   block that has it within its budget and counted there alone, so counts need no pairs: a node gives the number of links of
   each member and a spanning forest of them. Forests are joined to components.

Nothing is lost: rounding is met by a slightly larger budget in steps 2 and 3, and the cosine alone decides.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from millrace.llm.encoding import once_per_worker
from millrace.llm.near_dup import components
from millrace.llm.vp_search import usable
from millrace.operators.joins import hot_keys, join_apart
from millrace.session import stage

COSINE = 0.98
# Coordinates of a block: few enough to cut space into cells, enough to tell vectors apart.
SIDE = 8
NODE_LIMIT = 4096
# Components of the pairs that are verified at once.
AT_ONCE = 1 << 22
# Coordinates that are rotated together.
TURN = 256
# Squared distances are taken as smaller by this much until they are verified.
SLACK = 1e-6

_MEMBER = "node bigint, c binary, block int, x array<float>, reach float, guest int, side int"
_K = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def turns(width: int) -> list[tuple[np.ndarray, list[np.ndarray]]]:
    """Two rounds of (order of the coordinates, rotations of each ``TURN`` of them); one round where that is all of them."""
    rng = np.random.default_rng(width)
    rounds = []
    for _ in range(1 if width <= TURN else 2):
        sizes = [min(TURN, width - at) for at in range(0, width, TURN)]
        rounds.append((rng.permutation(width), [np.linalg.qr(rng.standard_normal((n, n)))[0] for n in sizes]))
    return rounds


def rotated(unit: np.ndarray) -> np.ndarray:
    """Rows turned so that what sets vectors apart is spread over all coordinates; lengths and distances stay."""
    for order, blocks in once_per_worker(("turns", unit.shape[1]), lambda: turns(unit.shape[1])):
        unit = unit[:, order]
        at = 0
        for turn in blocks:
            unit[:, at : at + len(turn)] = unit[:, at : at + len(turn)] @ turn
            at += len(turn)
    return unit


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, which changes no cosine and lets no square overflow."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, initial=0))[1][:, None])


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of scaled rows in double precision."""
    return (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))


def _widths(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """The rows of each width of a vector column, with their vectors."""
    sizes = batch.column(column).value_lengths().to_numpy()
    for width in np.unique(sizes):
        part = batch.filter(pa.array(sizes == width)) if (sizes != width).any() else batch
        yield part, part.column(column).flatten().to_numpy().reshape(part.num_rows, int(width))


def _digests(rows: DataFrame, label_kind: str) -> DataFrame:
    """``id, label, v, c``: the digest of a vector and its label, equal where both are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, v in _widths(batch, 2):
                x = np.ascontiguousarray(v + 0.0)  # no negative zeros
                keys = [
                    hashlib.blake2b(row.tobytes() + str(label).encode(), digest_size=16).digest()
                    for row, label in zip(x, part.column(1).to_pylist())
                ]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(keys, pa.binary())], ["id", "label", "v", "c"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, label {label_kind}, v array<double>, c binary")


def _with_rotation(classes: DataFrame) -> DataFrame:
    """The classes with ``turned``, their rotated unit vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("v")
        for batch in batches:
            for part, v in _widths(batch, at):
                x = scaled(v)
                turned = rotated(x / np.sqrt((x * x).sum(axis=1))[:, None]).astype(np.float32)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(list(turned), pa.list_(pa.float32()))], [*names, "turned"])

    names = classes.columns
    return classes.mapInArrow(run, StructType([*classes.schema.fields, StructField("turned", ArrayType(FloatType()))]))


def budgets(width: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """(first coordinate, share of the squared distance) of each block."""
    starts = np.arange(0, width, SIDE)
    sizes = np.minimum(SIDE, width - starts)
    return starts, (2 - 2 * cosine) * sizes / width + SLACK


def _blocks(classes: DataFrame, cosine: float) -> DataFrame:
    """Every class once in each block: the members of the first nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, x in _widths(batch, 2):
                starts, shares = budgets(x.shape[1], cosine)
                label = part.column(1).to_numpy().view(np.uint64) + np.uint64(x.shape[1])
                for b, (start, share) in enumerate(zip(starts, shares)):
                    held = np.zeros((len(x), SIDE), np.float32)
                    held[:, : x.shape[1] - start] = x[:, start : start + SIDE]
                    yield _members(_mix(label ^ _mix(np.array([b + 1], np.uint64) * _K)), part.column(0), np.full(len(x), b), held, np.full(len(x), np.sqrt(share)))

    return classes.select("c", F.xxhash64("label"), "turned").mapInArrow(run, _MEMBER)


def _members(node, c, block, x, reach, guest=None, side=None) -> pa.RecordBatch:
    n = len(node)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(node.view(np.int64)), c, pa.array(block, pa.int32()), pa.array(list(x), pa.list_(pa.float32())), pa.array(reach, pa.float32()),
            pa.array(np.zeros(n) if guest is None else guest, pa.int32()), pa.array(np.zeros(n) if side is None else side, pa.int32()),
        ],
        ["node", "c", "block", "x", "reach", "guest", "side"],
    )


def _cut(members: DataFrame, place: int) -> DataFrame:
    """Members of large nodes in the cells along one coordinate of their block, guests of the cell below included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, block = batch.column(0).to_numpy().view(np.uint64), batch.column(2).to_numpy()
            x = batch.column(3).flatten().to_numpy().reshape(len(node), SIDE)
            reach, guest = batch.column(4).to_numpy(), batch.column(5).to_numpy()
            at, wide = x[:, place].astype(np.float64), 2.0 * reach
            cell = np.floor(at / wide)
            key = lambda c, of: _mix(of ^ _mix((c.astype(np.int64).view(np.uint64) + np.array([place + 1], np.uint64) * _K)))
            yield _members(key(cell, node), batch.column(1), block, x, reach, guest)
            low = np.flatnonzero(at - cell * wide <= reach * (1 + 1e-6))
            if len(low):
                yield _members(
                    key(cell[low] - 1, node[low]), batch.column(1).take(pa.array(low)), block[low], x[low], reach[low], guest[low] | (1 << place)
                )

    return members.mapInArrow(run, _MEMBER)


def _in_pairs(members: DataFrame, node_limit: int) -> DataFrame:
    """Members of nodes that stay large, in all pairs of sub-blocks of half the limit; ``side`` tells the two apart."""
    half = max(1, node_limit // 2)
    part = F.pmod(F.xxhash64("c"), F.col("parts"))
    dealt = members.withColumn("parts", F.ceil(F.col("n") / half)).withColumn("own", part)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    node = F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other"))
    return dealt.select(node.alias("node"), "c", "block", "x", "reach", "guest", side.cast("int").alias("side"))


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one node at a time, from batches that are sorted by node."""
    held: list[pa.RecordBatch] = []
    last = None

    def whole() -> pa.RecordBatch:
        return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        node = batch.column(0).to_numpy()
        begin = [0, *(np.flatnonzero(node[1:] != node[:-1]) + 1).tolist(), len(node)]
        for a, b in zip(begin, begin[1:]):
            if held and node[a] != last:
                yield whole()
                held = []
            held.append(batch.slice(a, b - a))
            last = node[a]
    if held:
        yield whole()


def _may_meet(guest: np.ndarray, side: np.ndarray, a: slice) -> np.ndarray:
    """Whether rows of ``a`` and all rows are compared in this node and in no other of their block."""
    apart = side[a, None] != side[None, :] if side.any() else True
    return ((guest[a, None] & guest[None, :]) == 0) & apart


def _partnered(members: DataFrame) -> DataFrame:
    """``node, c, block, guest, side`` of the members that have a partner in their node, by the block alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _nodes(batches):
            x = rows.column(3).flatten().to_numpy().reshape(rows.num_rows, SIDE)
            guest, side = rows.column(5).to_numpy(), rows.column(6).to_numpy()
            square = (x * x).sum(axis=1)
            # Single precision here; a little more room than the rounding of coordinates up to 1 takes.
            budget = float(rows.column(4).to_numpy().max()) ** 2 + 1e-5
            some = np.zeros(len(x), bool)
            for at in range(0, len(x), 256):
                a = slice(at, at + 256)
                near = square[a, None] + square[None, :] - 2 * (x[a] @ x.T) <= budget
                near &= _may_meet(guest, side, a)
                near[np.arange(len(near)), np.arange(at, at + len(near))] = False
                some[a] = near.any(axis=1)
            if some.any():
                yield rows.filter(pa.array(some)).select(["node", "c", "block", "guest", "side"])

    dealt = members.repartition("node").sortWithinPartitions("node")
    return dealt.mapInArrow(run, "node bigint, c binary, block int, guest int, side int")


def _first_met(turned: np.ndarray, i: np.ndarray, j: np.ndarray, block: int, starts: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Pairs that are within the budget of this block and of none before it; the same wherever a pair is looked at."""
    end = starts[block] + SIDE
    square = np.add.reduceat((turned[i, :end] - turned[j, :end]) ** 2, starts[: block + 1], axis=1)
    within = square <= shares[: block + 1]
    return within[:, block] & ~within[:, :block].any(axis=1)


def links_of(
    vectors: np.ndarray, turned: np.ndarray, guest: np.ndarray, side: np.ndarray, weight: np.ndarray, block: int, cosine: float
) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(weights of the linked others of each row, spanning forest) of the pairs that this node has to verify."""
    n = len(vectors)
    starts, shares = budgets(turned.shape[1], cosine)
    x, wide = scaled(vectors), turned.astype(np.float64)
    part = wide[:, starts[block] : starts[block] + SIDE]
    square = (part * part).sum(axis=1)
    links, label, forest = np.zeros(n, np.int64), np.arange(n), []
    for at in range(0, n, 64):
        a = slice(at, at + 64)
        near = square[a, None] + square[None, :] - 2 * (part[a] @ part.T) <= shares[block] + SLACK
        near &= _may_meet(guest, side, a)
        i, j = np.nonzero(near)
        i += at
        i, j = i[i < j], j[i < j]
        good = np.zeros(len(i), bool)
        step = max(1, AT_ONCE // x.shape[1])
        for b in range(0, len(i), step):
            p, q = i[b : b + step], j[b : b + step]
            held = np.flatnonzero(_first_met(wide, p, q, block, starts, shares))
            good[b + held[cosines(x[p[held]], x[q[held]]) >= cosine]] = True
        i, j = i[good], j[good]
        np.add.at(links, i, weight[j])
        np.add.at(links, j, weight[i])
        open_ = label[i] != label[j]
        while open_.any():
            i, j = i[open_], j[open_]
            forest.append((int(i[0]), int(j[0])))
            label[label == label[j[0]]] = label[i[0]]
            open_ = label[i] != label[j]
    return links, forest


def _verified(nodes: DataFrame, classes: DataFrame, cosine: float) -> DataFrame:
    """``a, b, links``: per node the number of linked vectors of a member (``b`` null), and its forest (``links`` null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _nodes(batches):
            # Nodes are hashes, so look at the label as well.
            label = np.unique(rows.column(5).to_numpy(zero_copy_only=False), return_inverse=True)[1]
            for of in np.unique(label) if label.any() else [0]:
                held = rows.filter(pa.array(label == of)) if label.any() else rows
                for part, v in _widths(held, 7):
                    turned = part.column(8).flatten().to_numpy().reshape(v.shape)
                    guest, side, weight = (part.column(k).to_numpy() for k in (3, 4, 6))
                    links, forest = links_of(v, turned, guest, side, weight, int(part.column(2)[0].as_py()), cosine)
                    c = part.column(1)
                    some = np.flatnonzero(links)
                    if not len(some):
                        continue
                    i, j = (pa.array([e[k] for e in forest], pa.int64()) for k in (0, 1))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.concat_arrays([c.take(pa.array(some)), c.take(i)]),
                            pa.concat_arrays([pa.nulls(len(some), pa.binary()), c.take(j)]),
                            pa.concat_arrays([pa.array(links[some]), pa.nulls(len(i), pa.int64())]),
                        ],
                        ["a", "b", "links"],
                    )

    wide = nodes.join(classes.select("c", F.col("label").cast("string").alias("label"), "n", "v", "turned"), "c")
    dealt = wide.select("node", "c", "block", "guest", "side", "label", "n", "v", "turned").repartition("node").sortWithinPartitions("node", "c")
    return dealt.mapInArrow(run, "a binary, b binary, links bigint")


def near_duplicates(
    vectors: DataFrame,
    cosine: float = COSINE,
    node_limit: int = NODE_LIMIT,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row; links are between vectors of one label and one width.

    Vectors that are null, zero or hold null or non-finite components, and rows without a label, link with nothing: no links, the
    component is their own id. Every row is a vector of its own, so rows of one id and equal rows link like others. A row
    without an id has the least id that it reaches, or null, and is not kept. ``kept`` says that the component is the own id. No
    rows give none. Other columns are not read. ``cosine`` is above 0.
    """
    ids, labels = vectors.schema[id_col].dataType.simpleString(), vectors.schema[label_col].dataType.simpleString()
    taken = usable(vector_col) & F.col(label_col).isNotNull()
    narrow = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"), taken.alias("_taken"))
    rows = stage(_digests(narrow.where("_taken").drop("_taken"), labels), "vectors-rows")
    classes = stage(
        _with_rotation(
            rows.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least_id"), F.first("label").alias("label"), F.first("v").alias("v"))
        ),
        "vectors-classes",
    )
    placed, small = _blocks(classes, cosine), []
    for place in range(SIDE + 1):
        placed = stage(placed, "vectors-nodes")
        sizes = placed.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        large = stage(sizes.where(F.col("n") > node_limit), "vectors-large")
        # Nodes over the limit hold its rows each, so they are few beside all rows.
        small.append(placed.join(sizes.where(F.col("n") <= node_limit).select("node"), "node").select(placed.columns))
        if large.isEmpty():
            break
        members = placed.join(large, "node")
        if place == SIDE:
            small.append(_in_pairs(members, node_limit))
            break
        placed = _cut(members.select(placed.columns), place)
    dealt = small[0]
    for more in small[1:]:
        dealt = dealt.union(more)
    found = stage(_verified(stage(_partnered(dealt), "vectors-partners"), classes, cosine), "vectors-links")
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("c")).agg(F.sum("links").alias("links"))
    tied = stage(components(found.where("b IS NOT NULL").select("a", "b")).join(classes.select("c", "least_id"), "c"), "vectors-tied")
    least = tied.groupBy("label").agg(F.min("least_id").alias("component_id"))
    reached = tied.join(least, "label").select("c", "component_id")
    # Only classes with links or with several rows differ from a lone vector.
    linked = stage(
        classes.select("c", "n", "least_id").join(counts, "c", "left").join(reached, "c", "left").where("n > 1 OR links IS NOT NULL").select(
            "c", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
            F.when(F.col("links").isNull(), F.col("least_id")).otherwise(F.col("component_id")).alias("component_id"),
        ),
        "vectors-linked",
    )
    hot = stage(hot_keys(linked, "c"), "vectors-hot")
    joined = join_apart(rows.select("id", "c"), linked.drop("n"), "c", hot, "left")
    lone = narrow.where(~F.col("_taken")).select("id", F.lit(None).cast("bigint").alias("n_links"), F.lit(None).cast(ids).alias("component_id"))
    every = joined.select("id", "n_links", "component_id").union(lone)
    component = F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return every.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )


def near_duplicates_sql(cosine: float = COSINE) -> str:
    """The same by comparing all pairs of a label, as DuckDB SQL over ``embeddings`` whose ids are unique."""
    return f"""
WITH RECURSIVE vectors AS MATERIALIZED (
    SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
    WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x != 0)) > 0
), links AS MATERIALIZED (
    SELECT a.vec_id AS a, b.vec_id AS b FROM vectors a JOIN vectors b ON a.label = b.label AND a.vec_id != b.vec_id AND len(a.v) = len(b.v)
    WHERE list_cosine_similarity(a.v, b.v) >= {cosine}
), reached(a, b) AS (
    SELECT vec_id, vec_id FROM embeddings
    UNION
    SELECT reached.a, links.b FROM reached JOIN links ON reached.b = links.a
), counted AS (
    SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a
)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM (SELECT a AS vec_id, min(b) AS component_id FROM reached GROUP BY a) LEFT JOIN counted USING (vec_id)"""
