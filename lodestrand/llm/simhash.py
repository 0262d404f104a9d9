"""SimHash near-duplicates: fingerprints within a few bits, and the groups that such links make.

A fingerprint is embedded by counting the set bits of each of its segments. The Manhattan distance of
two such vectors is never above the Hamming distance of the fingerprints, so a range join in the grid
of count vectors finds all links: with ``bits`` differences spread over some groups of segments, all but
``bits`` groups have equal counts, and the cells of those groups are where partners meet. In a cell the
Manhattan bound goes first, the exact Hamming distance last. Counts are kept in unary, so that the
Manhattan distance of two vectors is the number of bits in which their codes differ. The number of groups
follows the number of fingerprints; a cell of many members is compared block by block, each pair of
blocks a group of its own, so no task holds a cell.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SEED, BITS = 42, 3
#: Members of a cell that a mean fingerprint is compared with, at most, in one grid (more fingerprints: more groups of
#: segments); members of a cell that make one block.
COMPARED, BLOCK = 4096, 4096
#: Shingles whose bits are counted at once; edges that a task contracts, about.
PIECE, LOCAL = 1 << 16, 1 << 18


def majority(hashes: np.ndarray) -> int:
    """The bits that over half the hashes have, as a signed number."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), PIECE):
        part = hashes[at : at + PIECE].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


def shingle_hashes(body: bytes, shingle: int) -> np.ndarray:
    """64-bit hashes of the shingles, repeats included, of lower-cased words; fewer words are one shingle, none have none."""
    words = body.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, seed, digest = b" ".join(words), SEED, xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(joined, seed)], np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = (end - size)[: len(words) - shingle + 1].tolist()
    return np.array([digest(joined[a:b], seed) for a, b in zip(start, end[shingle - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(body: bytes, shingle: int = 3) -> int:
    """64-bit SimHash, as a signed number; zero for a text without words."""
    return majority(shingle_hashes(body, shingle))


def fingerprints(docs: DataFrame, *, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp of every row; a text without words (null, empty, white space) has fingerprint zero. Narrow."""

    def make():
        return lambda batch: pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([fingerprint(b.as_py(), shingle) for b in batch.column("body")], pa.int64())], ["doc_id", "fp"]
        )

    rows = common.text_bytes(docs, id_col, text_col)
    return common.map_batches(rows, make, f"{common.typed(rows, 'doc_id')}, fp long")


def _signed(mask: int) -> int:
    return mask - 2**64 if mask >= 2**63 else mask


#: The lower bit of every two-bit segment.
LOW = int("01" * 32, 2)


def embedded(fp: Column) -> Column:
    """Counts of the 32 two-bit segments in unary: 00, 01 or 11."""
    low, high = fp.bitwiseAND(F.lit(LOW)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(LOW))
    return low.bitwiseOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def groups_for(count: int, bits: int = BITS, compared: int = COMPARED) -> int:
    """Groups of segments: at least twice ``bits``, and so many that ``count`` random fingerprints give a cell of ``compared``.

    Two segments of random fingerprints have equal counts with a probability of 3/8.
    """
    for groups in range(max(2 * bits, 1), 33):
        if count * 0.375 ** (32 * (groups - bits) // groups) <= compared:
            break
    return groups


def grid_masks(groups: int, bits: int = BITS) -> list[int]:
    """A mask for every choice of ``groups - bits`` of the groups of two-bit segments."""
    edges = [i * 32 // groups * 2 for i in range(groups + 1)]
    group = [(1 << b) - (1 << a) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return [_signed(sum(group[i] for i in chosen)) for chosen in combinations(range(groups), groups - bits)]


def _cells(nodes: DataFrame, code: Column, masks: list[int]) -> DataFrame:
    """grid, cell, fp: a row for every mask."""
    grid = F.explode(F.array(*(F.struct(F.lit(i).alias("grid"), F.lit(m).alias("mask")) for i, m in enumerate(masks))))
    return nodes.select("fp", code.alias("code"), grid.alias("g")).select("g.grid", F.col("code").bitwiseAND(F.col("g.mask")).alias("cell"), "fp")


def _linked_in_cell(bits: int):
    """Task function over (members): for each cell, a forest of its links as (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = [], []
            for members in batch.column("members"):
                fp = np.sort(np.array(members.as_py(), np.int64))
                raw = fp.view(np.uint64)
                low, high = raw & np.uint64(LOW), raw >> np.uint64(1) & np.uint64(LOW)
                code = low | high | (low & high) << np.uint64(1)
                todo, seen = np.ones(len(fp), bool), 0
                while seen < len(fp):
                    root = int(todo.argmax())
                    todo[root] = False
                    seen += 1
                    edge = [root]
                    while edge:
                        at = edge.pop()
                        rest = np.flatnonzero(todo)
                        near = rest[np.bitwise_count(code[rest] ^ code[at]) <= bits]
                        near = near[np.bitwise_count(raw[near] ^ raw[at]) <= bits]
                        todo[near] = False
                        seen += len(near)
                        edge.extend(near.tolist())
                        left.append(np.full(len(near), fp[at]))
                        right.append(fp[near])
            a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def links(nodes: DataFrame, *, bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """a, b: links between distinct fingerprints (``fp`` of ``nodes``, unique), enough to connect what is linked.

    Cells are counted before their members are gathered. Pairs come from the counts alone. The members of a
    larger cell are dealt to its blocks (one, unless there are more than ``block``), and each two blocks,
    and each with itself, are compared on their own.
    """
    if not 0 <= bits <= 6:
        raise ValueError("bits must be 0 to 6")
    cells = _cells(nodes, embedded(F.col("fp")), grid_masks(groups_for(nodes.count(), bits), bits))
    counted = common.cut(
        cells.groupBy("grid", "cell").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1")
    )
    near = lambda x, y: F.bit_count(x.bitwiseXOR(y)) <= bits
    a, b = F.col("a"), F.col("b")
    pairs = counted.where("n = 2").where(near(embedded(a), embedded(b)) & near(a, b)).select("a", "b")
    more = counted.where("n > 2").select("grid", "cell", F.ceil(F.col("n") / block).alias("blocks"))
    members = common.block_pairs(cells.join(more, ["grid", "cell"]), "fp").groupBy("grid", "cell", "low", "high")
    return pairs.unionByName(members.agg(F.collect_list("fp").alias("members")).select("members").mapInArrow(_linked_in_cell(bits), "a long, b long")).distinct()


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function over (a, b): each node of the task's edges with the smallest that it is connected with there, itself aside."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        path = []
        while (y := above.get(x, x)) != x:
            path.append(x)
            x = y
        for y in path:
            above[y] = x
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = top(a), top(b)
            if a != b:
                above[max(a, b)] = min(a, b)
    for at in range(0, len(nodes := list(above)), PIECE):
        some = nodes[at : at + PIECE]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([top(x) for x in some], pa.int64())], ["a", "b"])


def components(edges: DataFrame, *, local: int = LOCAL) -> DataFrame:
    """node, root: the smallest node that each node of ``edges`` (a, b: numbers) is connected with.

    First every task contracts about ``local`` edges to a forest; there are as many tasks as the edges need,
    and if one will do, that is all. Then large-star and small-star steps by turns, a checkpoint after each
    pair, until nothing changes. Every step is a grouped minimum and a join, so neither links nor nodes come
    to the driver.
    """

    def large(e: DataFrame) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()

    def small(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        up = down.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return up.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()

    def marked(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))"), F.expr("bit_xor(xxhash64(b, a, 1))")).first())

    given = common.cut(edges.where("a <> b").select("a", "b"))
    tasks = max(1, -(-given.count() // local))
    now = common.cut(given.coalesce(tasks).mapInArrow(_forest, "a long, b long"))
    if tasks > 1:
        now = common.cut(small(now))
        before, state = None, marked(now)
        while state != before:
            now = common.cut(small(large(now)))
            before, state = state, marked(now)
    roots = now.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_duplicates(docs: DataFrame, *, bits: int = BITS, shingle: int = 3, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id of every row: the smallest id among all rows whose fingerprints it reaches by links.

    Rows with equal fingerprints, and so equal texts, are one node, which is counted before its shuffle;
    texts without words have fingerprint zero and link like others. Null ids are skipped where the
    smallest is sought; a group of null ids only has a null one. Empty tables give empty results; other
    columns are not read. Texts of any length are read whole.
    """
    rows = common.cut(fingerprints(docs, shingle=shingle, id_col=id_col, text_col=text_col))
    return rows.join(component_of(rows, bits=bits, block=block), "fp").select("doc_id", "fp", "component_id")


def component_of(rows: DataFrame, *, bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """fp, component_id, node: for each distinct fp of ``rows`` (doc_id, fp), its group's smallest id and fp."""
    nodes = common.cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(nodes.select("fp"), bits=bits, block=block))
    rooted = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("node"))
    smallest = rooted.groupBy("node").agg(F.min("least").alias("component_id"))
    return rooted.select("fp", "node").join(smallest, "node").select("fp", "component_id", "node")
