"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations only.

Fixed masks pick some of a window's word positions and ignore the others. Their hashes are computed at
every word of the corpus and of the benchmark and joined; around each hit the two texts are laid side by
side and equal words are counted, so substituted words cost as much as they are many.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Words of an overlap, and the share of them that must be equal, place by place.
OVERLAP, SIMILARITY = 13, 0.8
#: Word positions that a seed reads. Whichever 2 of 13 words are substituted, one of the two masks fits
#: between them, so no overlap of 13 words with 11 equal goes unseen (see the tests).
MASKS = ((0, 1, 2, 4, 6, 9), (0, 1, 4, 5, 6, 7))
#: Bytes of seeds (with the words around them) that are broadcast at once; a benchmark with more goes in blocks, each
#: against all rows.
MAX_BYTES = 64 << 20

_SPLIT = r"[^\p{L}\p{M}\p{N}]+"


def words(text):
    """Lower-cased runs of letters, marks and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), _SPLIT), "")


def _seed(index: int, mask, w, at):
    return F.xxhash64(F.lit(index), *(F.get(w, at + o) for o in mask))


def _fits(w, at, mask):
    return at + max(mask) < F.size(w)


def covers(masks, overlap: int, need: int) -> bool:
    """Whether some mask, at some place, fits into an overlap beside any ``overlap - need`` words that differ."""
    reads = [{o + s for o in m} for m in masks for s in range(overlap - max(m))]
    return all(any(r.isdisjoint(differ) for r in reads) for differ in combinations(range(overlap), overlap - need))


def seeds(items: DataFrame, overlap: int, masks) -> DataFrame:
    """seed, item_id, near, near_at, wide: every seed of every item, items of fewer than ``overlap`` words by all their words.

    ``near`` has the item's words around the seed, as many as an overlap that holds it can reach, ``near_at``
    the seed's place in it, ``wide`` the words that must overlap.
    """
    n = F.size("w")
    long = items.where(n >= overlap).select("item_id", "w", F.explode(F.sequence(F.lit(0), n - 1)).alias("at"))
    per_mask = [
        long.where(_fits(F.col("w"), F.col("at"), m)).select(_seed(i, m, F.col("w"), F.col("at")).alias("seed"), "item_id", "w", "at")
        for i, m in enumerate(masks)
    ]
    out = per_mask[0]
    for one in per_mask[1:]:
        out = out.unionByName(one)
    for length in range(1, overlap):
        short = items.where(n == length)
        out = out.unionByName(short.select(_seed(-length, range(length), F.col("w"), F.lit(0)).alias("seed"), "item_id", "w", F.lit(0).alias("at")))
    back = F.least("at", F.lit(overlap - 1))
    return out.select("seed", "item_id", F.slice("w", F.col("at") - back + 1, back + 2 * overlap).alias("near"), back.alias("near_at"), F.least(F.lit(overlap), n).alias("wide"))


def contaminated(
    docs: DataFrame, benchmark: DataFrame, *, overlap: int = OVERLAP, similarity: float = SIMILARITY, masks=MASKS, max_bytes: int = MAX_BYTES,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """doc_id, item_id, equal_words, first_word: the rows of ``docs`` that overlap an item, one row a pair.

    A text overlaps an item if some ``overlap`` of its words in a row equal as many of the item's, place by
    place, in at least a share of ``similarity``; of an item with fewer words, if it has all of them in a
    row. equal_words is the best such count and first_word the least place (from 0) of an overlap. Words
    are lower-cased runs of letters, marks and digits. Null and empty texts and items overlap nothing;
    texts of any length are searched whole; repeated rows give one pair; rows with null ids count as one;
    null item ids are items like others; empty tables give an empty result; other columns are not read.
    ``masks`` must find all such overlaps, or the call is refused.

    The corpus isn't shuffled: seeds of the benchmark are broadcast, about ``max_bytes`` at a time, and
    only pairs found go on, pre-aggregated. Nothing but hits and their few words around leaves the scan.
    """
    need = math.ceil(overlap * similarity - 1e-9)
    if not covers(masks, overlap, need):
        raise ValueError(f"these masks don't find all overlaps of {overlap} words with {need} equal")
    items = benchmark.select(F.col(item_col).alias("item_id"), words(F.col(item_text_col)).alias("w")).where(F.size("w") > 0)
    known = common.cut(seeds(items, overlap, masks))
    weight = F.lit(64) + F.aggregate("near", F.lit(0).cast("long"), lambda x, y: x + 16 + F.octet_length(y))
    blocks = max(1, -(-(known.agg(F.sum(weight)).first()[0] or 0) // max_bytes))
    short = [r[0] for r in known.where(F.col("wide") < overlap).select("wide").distinct().collect()]  # overlap - 1 lengths at most
    w, at = F.col("w"), F.col("at")
    texts = docs.select(F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("w"))
    starts = texts.select("doc_id", "w", F.explode_outer(F.when(F.size(w) > 0, F.sequence(F.lit(0), F.size(w) - 1))).alias("at"))
    hashes = [F.when(_fits(w, at, m), _seed(i, m, w, at)) for i, m in enumerate(masks)]
    hashes += [F.when(_fits(w, at, range(n)), _seed(-n, range(n), w, at)) for n in sorted(short)]
    hashed = starts.select("doc_id", "w", "at", F.explode(F.array(*hashes)).alias("seed"))
    found = None
    for block in range(blocks):
        part = known.where(F.pmod(F.xxhash64("seed", "item_id", "near_at"), F.lit(blocks)) == block)
        back = F.least("at", "near_at")
        hits = hashed.join(F.broadcast(part), "seed").select(
            "doc_id", "item_id", "wide", (F.col("at") - back).alias("from"),
            F.slice("w", F.col("at") - back + 1, back + 2 * overlap).alias("a"), F.slice("near", F.col("near_at") - back + 1, back + 2 * overlap).alias("b"),
        )
        found = hits if found is None else found.unionByName(hits)
    same = F.transform(F.sequence(F.lit(1), F.least(F.size("a"), F.size("b"))), lambda i: F.when(F.get("a", i - 1) == F.get("b", i - 1), 1).otherwise(0))
    # No filter before the grouping: it would become a condition of the join, end the scan's generated code
    # and so copy every text's words for each of its places.
    laid = found.select("doc_id", "item_id", "wide", "from", same.alias("same"))
    counts = F.transform(
        F.when(F.size("same") >= F.col("wide"), F.sequence(F.lit(1), F.size("same") - F.col("wide") + 1)),
        lambda s: F.aggregate(F.slice("same", s, F.col("wide")), F.lit(0), lambda x, y: x + y),
    )
    least = F.when(F.col("wide") < overlap, F.col("wide")).otherwise(F.lit(need))
    counted = laid.select("doc_id", "item_id", "from", least.alias("least"), counts.alias("counts"))
    judged = counted.select(
        "doc_id", "item_id", F.struct(F.array_max("counts").alias("best"), "least").alias("got"),
        (F.col("from") + F.array_position(F.transform("counts", lambda c: c >= F.col("least")), True) - 1).alias("first"),
    )
    passes = F.col("got.best") >= F.col("got.least")
    return (
        judged.groupBy("doc_id", "item_id")
        .agg(F.max(F.when(passes, F.col("got.best"))).cast("long").alias("equal_words"), F.min(F.when(passes, F.col("first"))).cast("long").alias("first_word"))
        .where("equal_words IS NOT NULL")
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that overlap no item.

    Rows are known by two hashes of all their columns, so a clean row stays even where another of its id goes.
    Null and empty texts are clean; repeated rows stay or go together; an empty table gives an empty result
    and an empty benchmark leaves all rows. What is found, two hashes a row, is joined by whichever way
    Spark's own size checks choose.
    """
    key = F.struct(*common.row_key(docs, id_col, text_col)).alias("row_key")
    texts = docs.select(key, F.col(text_col).alias("text"))
    found = common.cut(contaminated(texts, benchmark, id_col="row_key", **settings).select(F.col("doc_id.k1").alias("k1"), F.col("doc_id.k2").alias("k2")).distinct())
    held = docs.select(*common.row_key(docs, id_col, text_col), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    return held.join(found, ["k1", "k2"], "left_anti").select("row.*")
