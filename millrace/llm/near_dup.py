"""Near-duplicate documents by a chosen-path set similarity join and connected components.

1. Each text becomes the set of its distinct word shingles. Equal sets are one class from here on, so exact copies cost
   one row each, whatever their number. A class is known by a key of 16 bytes made of its set, never by an id.
2. Chosen paths: in each of several independent trees a class goes to the node of its first minwise token. A node with more
   than ``node_limit`` members branches: each member goes on to ``BRANCHES`` children, chosen by minwise tokens at places
   that the node draws. A pair of similarity s stays together at the root with probability s and then survives a
   branching with probability 1 - (1 - s * rest)**2, so T trees miss a pair at 0.85 with probability 0.15**T where nodes
   are small, and 0.18**T where they go deep: below 10**-5 for 8 trees. At 0.8 it is 0.2**T and 0.25**T, below 2 * 10**-5.
3. Before a large node branches, all its members are compared with one pivot. Members linked to the pivot are in one
   component. 1 - similarity is a metric, so what is linked to one of them has a similarity of at least 2 * threshold - 1 with
   the pivot; if no unlinked member comes near that, they leave the node. So a hot group of near copies takes one pass and is
   never turned into pairs. What is still large after ``DEPTH`` levels is compared in blocks, all of it.
4. Small nodes are compared exhaustively: first by sketches of 128 minwise tokens, which leaves the members that have a likely
   partner in the node; then, for these, by their full sets, all pairs at once as products of membership matrices. A node
   gives a spanning forest of its links, so never more rows than members. A node met in several trees is compared once.
5. Classes that share an id are linked. Confirmed links are joined to components by alternating large-star and small-star
   steps.

Sketches only choose what is confirmed: a pair at the threshold is overlooked by its sketch about once in 60,000 times.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from millrace.llm.encoding import text_rows, unused
from millrace.session import stage

SHINGLE = 5
PERCENT = 85
SKETCH = 128
TREES = 8
BRANCHES = 2
DEPTH = 6
NODE_LIMIT = 4096
# A pair is confirmed if its share of equal sketch places is at most this many deviations below what is asked for.
DEVIATIONS = 4.12
FILTER_BITS = 23
# Bytes of a word that are hashed one by one.
HEAD = 32

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_R = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def least_alike(similarity: float) -> float:
    """Least share of equal sketch places at which two sets may have this similarity."""
    held = min(max(similarity, 0.0), 1.0)
    return max(0.0, held - DEVIATIONS * math.sqrt(held * (1 - held) / SKETCH))


def _places(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 32, n, np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, np.uint32) | np.uint32(1)


def shingle_set(text: str, size: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a text; fewer words than one shingle count as one."""
    raw = _LOWER[np.frombuffer(text.encode(), np.uint8)]
    word = ~_SPACE[raw]
    edge = np.diff(np.concatenate([[False], word, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, np.uint64)
    # Horner's rule over the first bytes of each word, a byte of all words at a time; what a word has beyond them is added in
    # chunks that are mixed with their place. Nothing depends on the other words of the text.
    lengths = ends - starts
    hashes = lengths.astype(np.uint64)
    order = np.argsort(lengths, kind="stable")
    sorted_lengths = lengths[order]
    for k in range(min(HEAD, int(sorted_lengths[-1]))):
        rest = order[np.searchsorted(sorted_lengths, k, side="right") :]
        hashes[rest] = (hashes[rest] ^ raw[starts[rest] + k]) * _R + np.uint64(k)
    long = order[np.searchsorted(sorted_lengths, HEAD, side="right") :]
    if len(long):
        tails = [raw[a + HEAD : b].tobytes() for a, b in zip(starts[long], ends[long])]
        chunks = np.frombuffer(b"".join(t + bytes(-len(t) % 8) for t in tails), "<u8")
        sizes = np.array([(len(t) + 7) // 8 for t in tails])
        begin = np.cumsum(sizes) - sizes
        place = (np.arange(len(chunks)) - np.repeat(begin, sizes)).astype(np.uint64)
        hashes[long] = _mix(hashes[long]) + np.add.reduceat(_mix(chunks ^ _mix((place + np.uint64(1)) * _R)), begin)
    hashes = _mix(hashes)
    n = max(1, len(hashes) - size + 1)
    out = np.full(n, min(len(hashes), size), np.uint64)
    for k in range(min(size, len(hashes))):
        out = _mix(out * _R + hashes[k : k + n])
    return np.unique(out)


_A, _B = _places(SKETCH + TREES * 4, 7)


def signature(shingles: np.ndarray, trees: int = TREES) -> tuple[bytes, bytes]:
    """(first tokens of each tree as 32-bit words, sketch as 16-bit words) of a set that is not empty."""
    low, high = (shingles & np.uint64(0xFFFFFFFF)).astype(np.uint32), (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(SKETCH + trees, 0xFFFFFFFF, np.uint32)
    a, b = _A[: SKETCH + trees, None], _B[: SKETCH + trees, None]
    for at in range(0, len(low), 2048):
        values = low[None, at : at + 2048] * a + high[None, at : at + 2048] * b
        values ^= values >> np.uint32(15)
        values *= np.uint32(0x2C1B3C6D)
        least = np.minimum(least, values.min(axis=1))
    return least[SKETCH:].tobytes(), ((least[:SKETCH] * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16).tobytes()


def class_key(shingles: np.ndarray) -> bytes | None:
    """16 bytes that stand for a set; none for the empty one."""
    if not len(shingles):
        return None
    return np.array([np.add.reduce(_mix(shingles)), np.add.reduce(_mix(shingles ^ _R) * _R)], np.uint64).tobytes()


def document_sets(docs: DataFrame, trees: int = TREES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, c, tokens, sketch`` of every whole text, ``c`` the key of its class; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in text_rows(batches):
            rows = []
            for text in texts:
                held = shingle_set(text)
                rows.append((len(held), class_key(held), *(signature(held, trees) if len(held) else (None, None))))
            n, c, tokens, sketches = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [keys, pa.array(n, pa.int64()), pa.array(c, pa.binary()), pa.array(tokens, pa.binary()), pa.array(sketches, pa.binary())],
                ["doc_id", "n_shingles", "c", "tokens", "sketch"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), text_col).mapInArrow(
        run, f"doc_id {kind}, n_shingles bigint, c binary, tokens binary, sketch binary"
    )


def _roots(classes: DataFrame, trees: int) -> DataFrame:
    """``node, c``: each class in the node of its first token of each tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(batch.num_rows, trees)
            keys = _mix(words.astype(np.uint64) + (np.arange(trees, dtype=np.uint64) + np.uint64(1)) * _R)
            c = batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), trees)))
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), c], ["node", "c"])

    return classes.select("c", "tokens").mapInArrow(run, f"node bigint, c {classes.schema['c'].dataType.simpleString()}")


def _children(members: DataFrame) -> DataFrame:
    """``node, c`` of the next level for members ``node, c, sketch`` of nodes that branch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch.column(0).to_numpy().view(np.uint64)
            sketch = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint16).reshape(len(node), SKETCH)
            for k in range(BRANCHES):
                drawn = _mix(node + np.uint64(k + 1) * _R)
                place = (drawn % np.uint64(SKETCH)).astype(np.int64)
                token = sketch[np.arange(len(node)), place].astype(np.uint64)
                keys = _mix(drawn ^ (token + np.uint64(1)) * _R)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), batch.column(1)], ["node", "c"])

    kind = members.schema["c"].dataType.simpleString()
    return members.select("node", "c", "sketch").mapInArrow(run, f"node bigint, c {kind}")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
    """Rows of one node at a time, from batches that are sorted by node."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        rows = batch.to_pandas()
        cuts = np.flatnonzero(rows["node"].to_numpy()[1:] != rows["node"].to_numpy()[:-1]) + 1
        parts = [rows.iloc[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]
        if held and len(parts) and held[-1]["node"].iloc[-1] != parts[0]["node"].iloc[0]:
            yield pd.concat(held)
            held = []
        for part in parts[:-1]:
            held.append(part)
            yield pd.concat(held)
            held = []
        if parts:
            held.append(parts[-1])
    if held:
        yield pd.concat(held)


def _with_partner(members: DataFrame, least: float) -> DataFrame:
    """``node, c`` of the members ``node, c, sketch`` of small nodes that have a likely partner in their node."""
    kind = members.schema["c"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes: list = []
        kept: list = []
        for rows in _groups(batches):
            sketch = np.frombuffer(b"".join(rows["sketch"]), np.uint16).reshape(len(rows), SKETCH)
            some = np.zeros(len(rows), bool)
            for at in range(0, len(rows), 64):
                like = (sketch[at : at + 64, None, :] == sketch[None, :, :]).sum(axis=2, dtype=np.uint8)
                like[np.arange(len(like)), np.arange(at, at + len(like))] = 0
                some[at : at + 64] = like.max(axis=1) >= least * SKETCH
            kept += rows["c"].to_numpy()[some].tolist()
            nodes += [rows["node"].iloc[0]] * int(some.sum())
            if len(kept) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(kept)], ["node", "c"])
                nodes, kept = [], []
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(kept)], ["node", "c"])

    dealt = members.select("node", "c", "sketch").repartition("node").sortWithinPartitions("node")
    return dealt.mapInArrow(run, f"node bigint, c {kind}")


def linked_pairs(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of sets with 100 * intersection >= percent * union; every pair is looked at."""
    n = len(sets)
    sizes = np.fromiter(map(len, sets), np.int64, n)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), sizes)
    shared = count[column] > 1
    row, column = row[shared], (np.cumsum(count > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((n, n), np.float32)  # whole numbers below 2**24 are exact
    wide = 2048
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, wide):
        a, b = np.searchsorted(column, [low, low + wide])
        member = np.zeros((n, wide), np.float32)
        member[row[a:b], column[a:b] - low] = 1
        both += member @ member.T
    label = np.arange(n)
    forest = []
    for i in range(1, n):
        # 100 * both >= percent * (a + b - both)
        near = np.flatnonzero((100 + percent) * both[i, :i].astype(np.int64) >= percent * (sizes[:i] + sizes[i]))
        while len(near):
            j = near[0]
            forest.append((int(j), i))
            label[label == label[i]] = label[j]
            near = near[label[near] != label[i]]
    return forest


def _node_links(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links ``a, b`` within nodes ``node, c``, confirmed on the full sets ``c, held``."""
    kind = nodes.schema["c"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_a: list = []
        out_b: list = []
        for rows in _groups(batches):
            c = rows["c"].tolist()
            for i, j in linked_pairs([np.frombuffer(x, np.uint64) for x in rows["held"]], percent):
                out_a.append(min(c[i], c[j]))
                out_b.append(max(c[i], c[j]))
        if out_a:
            yield pa.RecordBatch.from_arrays([pa.array(out_a), pa.array(out_b)], ["a", "b"])

    dealt = nodes.join(sets, "c").select("node", "c", "held").repartition("node").sortWithinPartitions("node", "c")
    return dealt.mapInArrow(run, f"a {kind}, b {kind}").where("a < b").distinct()


def _likely(docs: DataFrame, here: str, asked: DataFrame, there: str) -> DataFrame:
    """The rows whose value of column ``here`` may be one of column ``there``, by a bit filter of fixed size (1 MB)."""
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << FILTER_BITS))
    one = F.lit(1).cast("bigint")
    words = asked.select(bit(there).alias("x")).groupBy(F.expr("x div 64").alias("_word")).agg(
        F.bit_or(F.call_function("shiftleft", one, (F.col("x") % 64).cast("int"))).alias("_bits")
    )
    at = bit(here)
    picked = docs.join(F.broadcast(words), F.floor(at / 64) == F.col("_word")).where(
        F.col("_bits").bitwiseAND(F.call_function("shiftleft", one, (at % 64).cast("int"))) != 0
    )
    return picked.select(docs.columns)


def _full_sets(asked: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Stored ``c, held``: the full sets of the classes ``c`` that are asked for.

    Texts are not shuffled: a bit filter over the least ids of the classes picks the texts, and only the sets made of these
    that may be asked for are sent on, each once a task. A class without any id is looked for among the rows without one.
    """
    picked = _likely(docs.select(id_col, text_col), id_col, asked.join(classes.select("c", "least_id"), "c"), "least_id")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for _, texts in text_rows(batches):
            held: dict[bytes, bytes] = {}
            for text in texts:
                shingles = shingle_set(text)
                key = class_key(shingles)
                if key is not None and key not in seen:
                    seen.add(key)
                    held[key] = shingles.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.binary())], ["c", "held"])

    found = _likely(picked.mapInArrow(sets, "c binary, held binary"), "c", asked, "c")
    # Rows of one key hold equal sets.
    return stage(found.join(asked, "c", "left_semi").dropDuplicates(["c"]), "near-sets")


def _confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, percent: int, id_col: str, text_col: str) -> DataFrame:
    """The pairs ``a, b`` with 100 * intersection >= percent * union of their full sets."""
    asked = pairs.select(F.col("a").alias("c")).union(pairs.select(F.col("b").alias("c"))).distinct()
    found = _full_sets(asked, classes, docs, id_col, text_col)
    kind = classes.schema["c"].dataType.simpleString()
    wide = pairs.join(found.select(F.col("c").alias("a"), F.col("held").alias("x")), "a").join(
        found.select(F.col("c").alias("b"), F.col("held").alias("y")), "b"
    )

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3)):
                one, two = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(one, two, assume_unique=True))
                good.append(100 * both >= percent * (len(one) + len(two) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return stage(wide.select("a", "b", "x", "y").mapInArrow(check, f"a {kind}, b {kind}"), "near-links")


def components(links: DataFrame) -> DataFrame:
    """``c, label`` for every end of links ``a, b``: the least end that can be reached."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    before = None
    while True:
        # Large star: what is larger than u is tied to the least neighbour of u.
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Small star: u and what is smaller than u are tied to the least of these.
        large = large.where("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        edges = stage(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "near-stars")
        now = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == before or not now[0]:
            break
        before = now
    return edges.select(F.col("u").alias("c"), F.col("v").alias("label")).union(
        edges.select(F.col("v").alias("c"), F.col("v").alias("label")).distinct()
    )


def _nodes(placed: DataFrame) -> DataFrame:
    """``node, n, x`` of nodes with more than one member; x stands for the set of members."""
    return placed.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("c")).alias("x")).where("n > 1")


def _blocks(members: DataFrame, node_limit: int) -> DataFrame:
    """Members of nodes that stay large, in pairs of blocks of about half the limit, each pair a node."""
    half = max(1, node_limit // 2)
    block = members.withColumn("blocks", F.ceil(F.col("n") / half)).withColumn("block", F.pmod(F.xxhash64("c"), F.col("blocks")))
    with_other = block.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    return with_other.select(F.xxhash64("node", F.least("block", "other"), F.greatest("block", "other")).alias("node"), "c")


def near_duplicates(
    docs: DataFrame,
    percent: int = PERCENT,
    trees: int = TREES,
    node_limit: int = NODE_LIMIT,
    depth: int = DEPTH,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every document.

    Words are runs of other than white space, A-Z in lower case; a text of fewer than five words is one shingle. Texts that
    are null, empty or without words have no shingles and are linked with nothing. ``component_id`` is the least id
    that links reach, the document's own included; ``kept`` says that it is its own. Repeated rows of an id are one
    document, which reaches all that its texts reach. Rows without an id are documents of their own, linked by their texts
    like any other; a null id is never least: such a row has the least id that it reaches, or null, and is not kept. No rows
    give none. Other columns are not passed on.
    """
    return _reached(docs, percent, trees, node_limit, depth, id_col, text_col).select(
        F.col("doc_id").alias(id_col), "n_shingles", "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"),
    )


def _reached(docs: DataFrame, percent: int, trees: int, node_limit: int, depth: int, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, n_shingles, c, root, component_id`` of every row; the root is the least class of a component."""
    every = stage(document_sets(docs, trees, id_col, text_col), "near-documents")
    least = least_alike(percent / 100)
    classes = stage(
        every.where("c IS NOT NULL").groupBy("c").agg(
            F.min("doc_id").alias("least_id"), F.first("tokens").alias("tokens"), F.first("sketch").alias("sketch")
        ),
        "near-classes",
    )
    sketches = classes.select("c", "sketch")
    links: list[DataFrame] = []
    small: list[DataFrame] = []
    placed = _roots(classes, trees)
    for level in range(depth + 1):
        placed = stage(placed, "near-nodes")
        sizes = stage(_nodes(placed), "near-sizes")
        fit = sizes.where(F.col("n") <= node_limit).groupBy("n", "x").agg(F.min("node").alias("node"))
        small.append(placed.join(fit.select("node"), "node"))
        large = stage(sizes.where(F.col("n") > node_limit).groupBy("n", "x").agg(F.min("node").alias("node")), "near-large")
        if large.isEmpty():
            break
        large = stage(placed.join(large, "node").groupBy("node", "n").agg(F.min("c").alias("pivot")), "near-pivots")
        members = placed.join(large, "node").join(sketches, "c")
        if level == depth:
            small.append(_blocks(members, node_limit))
            break
        members, found = _around_pivots(members, sketches, classes, docs, percent, id_col, text_col)
        links.append(found)
        placed = _children(members)
    dealt = small[0]
    for more in small[1:]:
        dealt = dealt.union(more)
    nodes = stage(_with_partner(dealt.distinct().join(sketches, "c"), least), "near-members")
    # Most groups of copies meet in every tree.
    once = _nodes(nodes).groupBy("n", "x").agg(F.min("node").alias("node"))
    nodes = nodes.join(once.select("node"), "node")
    sets = _full_sets(nodes.select("c").distinct(), classes, docs, id_col, text_col)
    links.append(stage(_node_links(nodes, sets, percent), "near-links"))
    shared = _of_shared_ids(every)
    first = shared.groupBy("doc_id").agg(F.min("c").alias("a"))
    known = shared.join(first, "doc_id").select("a", F.col("c").alias("b")).where("a < b")
    for more in links:
        known = known.union(more)
    tied = stage(components(known).join(classes.select("c", "least_id"), "c"), "near-tied")
    least_ids = tied.groupBy("label").agg(F.min("least_id").alias("component_id"))
    tied = tied.join(least_ids, "label").select("c", F.col("label").alias("root"), "component_id")
    reached = classes.select("c", "least_id").join(tied, "c", "left").select(
        "c", F.coalesce("root", "c").alias("root"), F.when(F.col("root").isNull(), F.col("least_id")).otherwise(F.col("component_id")).alias("component_id")
    )
    rows = every.select("doc_id", "n_shingles", "c")
    columns = ["doc_id", "n_shingles", "c", "root", "component_id"]
    with_set = rows.where("c IS NOT NULL").join(reached, "c", "left").select(columns)
    # A row without shingles is where the other texts of its id are.
    by_id = shared.join(reached, "c").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    without = rows.where("c IS NULL").join(by_id, "doc_id", "left").withColumns(
        {"root": F.lit(None).cast("binary"), "component_id": F.coalesce("component_id", "doc_id")}
    )
    return with_set.union(without.select(columns))


def _of_shared_ids(every: DataFrame) -> DataFrame:
    """Stored ``doc_id, c``: the classes of ids whose rows are not all of one class."""
    key = F.xxhash64("c")
    several = every.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(key).alias("low"), F.max(key).alias("high")).where("low < high")
    held = every.where("c IS NOT NULL").join(several.select("doc_id"), "doc_id", "left_semi")
    return stage(held.select("doc_id", "c").distinct(), "near-shared")


def _around_pivots(
    members: DataFrame, sketches: DataFrame, classes: DataFrame, docs: DataFrame, percent: int, id_col: str, text_col: str
) -> tuple[DataFrame, DataFrame]:
    """Compare the members ``node, c, sketch, pivot`` of large nodes with their pivots: (members that go on, links)."""
    pivots = sketches.select(F.col("c").alias("pivot"), F.col("sketch").alias("pivot_sketch")).join(
        members.select("pivot").distinct(), "pivot", "left_semi"
    )
    kind = sketches.schema["c"].dataType.simpleString()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint16).reshape(-1, SKETCH)
            two = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint16).reshape(-1, SKETCH)
            like = pa.array((one == two).mean(axis=1), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], like], ["node", "c", "pivot", "sketch", "like"])

    compared = stage(
        members.join(pivots, "pivot").select("node", "c", "pivot", "sketch", "pivot_sketch").mapInArrow(
            compare, f"node bigint, c {kind}, pivot {kind}, sketch binary, like double"
        ),
        "near-compared",
    )
    likely = compared.where((F.col("like") >= least_alike(percent / 100)) & (F.col("c") != F.col("pivot")))
    links = _confirmed(likely.select(F.col("pivot").alias("a"), F.col("c").alias("b")).distinct(), classes, docs, percent, id_col, text_col)
    marked = compared.join(links.select(F.col("a").alias("pivot"), F.col("b").alias("c"), F.lit(True).alias("tied")), ["pivot", "c"], "left")
    marked = marked.withColumn("tied", F.coalesce("tied", F.col("c") == F.col("pivot")))
    # Unlinked members that may be linked to a linked one.
    close = (~F.col("tied")) & (F.col("like") >= least_alike(2 * percent / 100 - 1))
    open_nodes = marked.where(close).select("node").distinct().withColumn("open", F.lit(True))
    going = marked.join(open_nodes, "node", "left").where((~F.col("tied")) | F.coalesce("open", F.lit(False)))
    return going, links


def keep_first(
    docs: DataFrame,
    percent: int = PERCENT,
    trees: int = TREES,
    node_limit: int = NODE_LIMIT,
    depth: int = DEPTH,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row of each component of ``near_duplicates``: one of its least id, or of its least class where it has no id.

    Of several such rows, the one of least text that has a word. A row that has neither id nor word is a component. Texts are
    shuffled only where an id or a text without one is repeated.
    """
    found = stage(_reached(docs, percent, trees, node_limit, depth, id_col, text_col), "near-found")
    key, gone, n, of_text = unused(docs, "_id", "_gone", "_n", "_c")
    marks = stage(
        found.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias(key)).agg(
            F.max(F.col("doc_id") != F.col("component_id")).alias(gone), F.count(F.lit(1)).alias(n)
        ).where(F.col(gone) | (F.col(n) > 1)),
        "near-marks",
    )
    same = F.col(id_col) == F.col(key)
    kept = docs.where(F.col(id_col).isNotNull()).join(marks, same, "left_anti")
    again = marks.where(~F.col(gone))
    if not again.isEmpty():
        kept = kept.union(_one_row(docs.join(again, same, "left_semi"), id_col, docs.columns, text_col))
    unnamed = found.where("doc_id IS NULL")
    if not unnamed.isEmpty():
        keyed = _with_class(docs.where(F.col(id_col).isNull()), text_col, of_text)
        own = unnamed.where("component_id IS NULL AND c = root").select(F.col("c").alias(of_text)).distinct()
        kept = kept.union(keyed.where(F.col(of_text).isNull()).select(docs.columns))
        kept = kept.union(_one_row(keyed.join(own, of_text, "left_semi"), of_text, docs.columns, text_col))
    return kept


def _with_class(docs: DataFrame, text_col: str, name: str) -> DataFrame:
    """The rows with the key of the class of their text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [class_key(shingle_set(t)) for _, texts in text_rows(iter([batch.select([text_col, text_col])])) for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], [*batch.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, BinaryType())]))


def _one_row(docs: DataFrame, key: str, columns: list[str], text_col: str) -> DataFrame:
    """Of the rows of each key, the one of least text that has a word, the same on every run."""
    blank = F.btrim(F.coalesce(F.col(text_col), F.lit("")), F.lit(" \t\n\x0b\f\r")) == ""
    rest = [c for c in columns if c != text_col]
    order = F.struct(blank, F.col(text_col), F.to_json(F.struct(*rest)))
    return docs.groupBy(F.col(key).alias("_key")).agg(F.min_by(F.struct(*columns), order).alias("_row")).select("_row.*")
