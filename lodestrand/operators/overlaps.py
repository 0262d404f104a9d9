"""How many members two sets share, for given pairs of sets.

A join that hands both sets to each pair ships and hashes a set as often as it is asked for. Here the sets of
one side meet the pairs and sets of the other in blocks of both, each two blocks in one task: a set is shipped
once a block of the other side, and a pair costs a look at each member of its right set.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Left and right sets of a block at most, blocks of left sets that there are at least where there are 512 for each,
#: and right sets that one left set is laid beside at once. All right sets are shipped once a block of left ones.
LEFT, RIGHT, TASKS, BESIDE = 8192, 16_384, 24, 1024


def whole(column: pa.ChunkedArray) -> pa.Array:
    """A column as one array."""
    one = column.combine_chunks()
    return pa.concat_arrays(one.chunks) if isinstance(one, pa.ChunkedArray) else one


def flat(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """A list column's members one after the other, and where each row's begin, with the end."""
    lists = whole(column)
    return lists.flatten(), np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)


def places(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The places of the runs that begin and are as long as told, one run after the other."""
    end = np.cumsum(length)
    return np.repeat(begin - end + length, length) + np.arange(end[-1] if len(end) else 0)


def shared(pairs: DataFrame, left: DataFrame, right: DataFrame, *, left_block: int = LEFT, right_block: int = RIGHT) -> DataFrame:
    """l, r, n_l, n_r, met: the sizes of both sets of each pair and how many members they share, exactly.

    ``pairs`` (l, r) come without repeats; ``left`` (l, a) and ``right`` (r, b) have one array without repeats
    a key; pairs with a key that a side lacks are left out.
    """
    blocks = lambda df, size: max(1, -(-df.count() // size))
    n_left, n_right = blocks(left, left_block), blocks(right, right_block)
    n_left = max(n_left, min(TASKS, blocks(left, 512)))
    at = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    asked = pairs.groupBy("l", at("r", n_right).alias("rb")).agg(F.collect_list("r").alias("rs")).join(left.select("l", "a"), "l")
    asked = asked.select(at("l", n_left).alias("lb"), "rb", "l", "a", "rs")
    every = F.explode(F.sequence(F.lit(0), F.lit(n_left - 1)))
    sets = right.select(every.alias("lb"), at("r", n_right).alias("rb"), "r", "b")
    kinds = dict(pairs.dtypes)
    schema = pa.schema([("l", pa.string()), ("r", pa.string()), ("n_l", pa.int32()), ("n_r", pa.int32()), ("met", pa.int32())])
    if (kinds["l"], kinds["r"]) != ("string", "string"):
        raise ValueError("keys of sets are strings")

    def run(one: pa.Table, two: pa.Table) -> pa.Table:
        if not one.num_rows or not two.num_rows:
            return schema.empty_table()
        (mine, a), (theirs, b), (asked_, rs) = flat(one.column("a")), flat(two.column("b")), flat(one.column("rs"))
        coded = pa.concat_arrays([theirs, mine.cast(theirs.type)]).dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False)
        theirs_, mine_, marked = code[: len(theirs)], code[len(theirs) :], np.zeros(len(coded.dictionary), np.int8)
        names = two.column("r").combine_chunks()
        place = pc.fill_null(pc.index_in(asked_, value_set=names), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        length, met = np.diff(b), np.zeros(len(place), np.int32)
        for i in range(one.num_rows):
            marked[mine_[a[i] : a[i + 1]]] = 1
            for at in range(rs[i], rs[i + 1], BESIDE):
                some = slice(at, min(at + BESIDE, rs[i + 1]))
                own = np.maximum(place[some], 0)  # a key without a set goes below
                n = length[own]
                so_far, end = np.concatenate([[0], np.cumsum(marked[theirs_[places(b[own], n)]], dtype=np.int64)]), np.cumsum(n)
                met[some] = so_far[end] - so_far[end - n]
            marked[mine_[a[i] : a[i + 1]]] = 0
        known = np.flatnonzero(place >= 0)
        row = np.repeat(np.arange(one.num_rows), np.diff(rs))[known]
        keys = one.column("l").combine_chunks().take(pa.array(row))
        return pa.Table.from_arrays(
            [keys, asked_.take(pa.array(known)), pa.array(np.diff(a)[row].astype(np.int32)), pa.array(length[place[known]].astype(np.int32)), pa.array(met[known])], schema=schema
        )

    return asked.groupBy("lb", "rb").cogroup(sets.groupBy("lb", "rb")).applyInArrow(run, "l string, r string, n_l int, n_r int, met int")
