"""Removal of repeated passages with suffix arrays sorted by the deep-shallow method.

A byte goes if it lies in a string of ``length`` bytes that also starts anywhere else in the corpus. Only
suffixes at which such a string may start are sorted:

1. Every window of ``length`` bytes has an anchor, its smallest-hashed GRAM-byte string (leftmost at a
   tie). Equal windows have equal anchors at equal places, so windows whose anchor is unique in the corpus
   are done. Neighbouring windows with one anchor form a stretch; stretches are a few hundred bytes and
   about two for each hundred bytes of text, and only their hashes are shuffled.
2. Equal stretches are counted before anything else; they need one place in the sort. Stretches are dealt
   by ranges of (anchor, hash), so an anchor that a third of all texts have is spread over tasks.
3. Where an anchor has stretches that differ, one of each is fetched with its bytes and all suffixes that
   start its windows are sorted: multikey quicksort on eight-byte characters to SHALLOW bytes, then blind
   tries for the groups that are still together. Neighbours in that order that share ``length`` bytes are
   the repeated windows.
4. An anchor with very many stretches that differ is split first: STEPS neighbouring windows have all but
   a few of their bytes in common, and that common string takes the anchor's place in 2 and 3, then each
   window's own. Equal windows have equal strings, so the sort finds the same in smaller groups.
5. Windows that repeat make removed runs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

GRAM, SHALLOW = 64, 24
#: Bytes hashed at once (2 ** 23 at most, for places have 24 bits there; it only bounds memory); stretches that a task combines before it
#: sends them; bytes sorted at once.
PIECE, COMBINE, CHUNK = 1 << 19, 300_000, 8 << 20
#: Distinct stretches of one anchor that are sorted together; a larger group is split, by strings that so many
#: neighbouring windows share, one step after the other.
MAX_GROUP, STEPS = 2_000, (8, 1)
#: Copies of one text that are worked on together, or a ten-thousandth of all rows if that is more; more are dealt out.
#: Stretches whose texts are sought by broadcast, at most; more are joined.
COPIES, SOUGHT = 1_000, 50_000

_ONE, _TWO = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    m = (a ^ (b * _ONE + (b >> np.uint64(29)))) * _TWO
    return m ^ (m >> np.uint64(32))


def _words(buffer: bytes) -> np.ndarray:
    """The eight bytes from each place on, as little-endian numbers (a view)."""
    return np.ndarray((len(buffer) - 7,), "<u8", buffer=buffer, strides=(1,))


class Hashes:
    """Hashes of all strings of GRAM bytes in a buffer, and of longer ones."""

    def __init__(self, buffer: bytes, seed: int = 1):
        h = _mix(_words(buffer), np.full(1, seed * 7919, np.uint64))
        for n in (8, 16, 32):
            h = _mix(h[:-n], h[n:])
        self.gram = h

    def of(self, at: np.ndarray, length: int) -> np.ndarray:
        """Hashes of the strings of ``length`` bytes, GRAM at least, that start at ``at``."""
        whole, rest = divmod(length, GRAM)
        h = self.gram[at]
        for i in range(1, whole):
            h = _mix(h, self.gram[at + i * GRAM])
        return _mix(h, self.gram[at + length - GRAM]) if rest else h

    def names(self, first: np.ndarray, last: np.ndarray, length: int) -> np.ndarray:
        """Hashes of stretches by their first and last windows."""
        return _mix(_mix(self.of(first, length), self.of(last, length)), (last - first).astype(np.uint64))


#: The bits of a gram's hash that its place takes when the smallest is sought.
_LOW = np.uint64((1 << 24) - 1)


def stretches(buffer: bytes, first: np.ndarray, last: np.ndarray, length: int):
    """(start, windows, key, name) of the stretches of a buffer; windows start in [first, last] of each text."""
    counts = np.maximum(last - first + 1, 0)
    total = int(counts.sum())
    if not total:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
    h, wide, n_windows = Hashes(buffer), length - GRAM + 1, len(buffer) - length + 1
    value = (h.gram & ~_LOW) | np.arange(len(h.gram), dtype=np.uint64)
    value = np.concatenate([value, np.full(-len(value) % wide, ~np.uint64(0))]).reshape(-1, wide)
    ahead = np.minimum.accumulate(value, axis=1).ravel()
    back = np.minimum.accumulate(value[:, ::-1], axis=1)[:, ::-1].ravel()
    best = (np.minimum(back[:n_windows], ahead[wide - 1 : wide - 1 + n_windows]) & _LOW).astype(np.int64)
    at = np.repeat(first - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(total)
    anchor = best[at]
    new = np.flatnonzero((anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)) + 1
    start, end = at[np.concatenate([[0], new])], at[np.concatenate([new - 1, [total - 1]])]
    return start, end - start + 1, h.gram[anchor[np.concatenate([[0], new])]], h.names(start, end, length)


def _pieces(bodies: list[bytes], length: int):
    """(buffer, first, last, text index, place of the buffer's text in it) with each text's windows once."""
    buffer, first, last, owner, shift, size = [], [], [], [], [], 0
    for i, body in enumerate(bodies):
        for at in range(0, max(len(body) - length + 1, 0), PIECE):
            part = body[at : at + PIECE + length - 1]
            first.append(size)
            last.append(size + len(part) - length)
            owner.append(i)
            shift.append(at - size)
            buffer.append(part)
            size += len(part)
            if size >= PIECE:
                yield b"".join(buffer), *map(np.array, (first, last, owner, shift))
                buffer, first, last, owner, shift, size = [], [], [], [], [], 0
    if buffer:
        yield b"".join(buffer), *map(np.array, (first, last, owner, shift))


def deep_shallow_sort(buffer: bytes, starts: np.ndarray, limit: int, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at ``starts`` by their first ``limit`` bytes, and whether each equals the one before.

    ``buffer`` must reach ``limit`` bytes beyond every start. Shallow part: multikey quicksort, where a
    level sorts every group by its next eight bytes. Deep part: for each group that is left, a blind trie
    grows a spine at a time. All suffixes of a node are compared with one leaf; a suffix hangs off the
    node at the depth where they part, on the branch of its next byte. Nodes with two or more suffixes go
    on from that depth, so no byte of a common prefix is read again.
    """
    words = _words(buffer + b"\0" * 8)
    order = np.arange(len(starts))
    fresh = np.zeros(len(starts), bool)  # whether a new group of equals starts here
    if len(starts):
        fresh[0] = True
    live = np.arange(len(starts))  # places in the order that are still in groups of two or more
    group = np.zeros(len(starts), np.int64)
    for depth in range(0, min(shallow, limit - limit % 8), 8):
        if not len(live):
            break
        char = words[starts[order[live]] + depth].byteswap()
        by = np.lexsort((char, group))
        order[live], char = order[live][by], char[by]
        split = np.concatenate([[True], (char[1:] != char[:-1]) | (group[1:] != group[:-1])])
        live, group = _close(fresh, live, split)
    depth = np.full(len(live), min(shallow, limit - limit % 8))
    while len(live):
        head = np.concatenate([[True], group[1:] != group[:-1]])
        size = np.diff(np.concatenate([np.flatnonzero(head), [len(live)]]))
        leaf = np.repeat(starts[order[live]][np.flatnonzero(head) + size // 2], size)
        own = starts[order[live]]
        common_, side = _compare(words, own, leaf, depth, limit)
        branch = np.where(side == 0, 0, words[own + common_] & np.uint64(255)).astype(np.int64)
        place = np.where(side < 0, common_, -common_)
        by = np.lexsort((branch, place, side, group))
        order[live] = order[live][by]
        common_, side, branch, group = common_[by], side[by], branch[by], group[by]
        split = np.concatenate([[True], (group[1:] != group[:-1]) | (side[1:] != side[:-1]) | (common_[1:] != common_[:-1]) | (branch[1:] != branch[:-1])])
        fresh[live[split]] = True
        alone = split & np.concatenate([split[1:], [True]])
        keep = ~alone & (side != 0)
        live, depth, group = live[keep], common_[keep], np.cumsum(split)[keep]
    return order, ~fresh


def _close(fresh: np.ndarray, live: np.ndarray, split: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Note the new groups; what is left are those of two or more."""
    fresh[live[split]] = True
    keep = ~(split & np.concatenate([split[1:], [True]]))
    return live[keep], np.cumsum(split)[keep]


def _compare(words, own, leaf, depth, limit):
    """(bytes in common up to ``limit``, -1, 0 or 1 as own is below, equal to or above leaf)."""
    shared, side = np.full(len(own), limit), np.zeros(len(own), np.int8)
    todo = np.flatnonzero(own != leaf)
    at = depth[todo]
    while len(todo):
        a, b = words[own[todo] + at], words[leaf[todo] + at]
        differ = a ^ b
        part = differ != 0
        if part.any():
            bits = differ[part]
            byte = (np.log2((bits & (~bits + np.uint64(1))).astype(np.float64)) // 8).astype(np.int64)
            ends, i = at[part] + byte, todo[part]
            real = ends < limit
            shift = (byte * 8).astype(np.uint64)
            less = ((a[part] >> shift) & np.uint64(255)) < ((b[part] >> shift) & np.uint64(255))
            shared[i[real]] = ends[real]
            side[i[real]] = np.where(less, -1, 1)[real]
        on = ~part & (at + 8 < limit)
        todo, at = todo[on], at[on] + 8
    return shared, side


def _packed(start, n_windows, many):
    return start.astype(np.int64) << 20 | n_windows.astype(np.int64) << 1 | many


def _runs(tid: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tid, place) of the runs that these windows make; a run stays below 2 ** 18 windows or so."""
    by = np.lexsort((start, *tid.T))
    tid, start, end = tid[by], start[by], (start + n)[by]
    if not len(tid):
        return tid, _packed(start, n, 0)
    new = np.concatenate([[True], (tid[1:] != tid[:-1]).any(axis=1) | (start[1:] > end[:-1]) | (start[1:] >> 18 != start[:-1] >> 18)])
    first = np.flatnonzero(new)
    return tid[first], _packed(start[first], np.maximum.reduceat(end, first) - start[first], 0)


#: Columns of a stretch, or of a run of windows that repeat (``mark``), which has no anchor and is dealt by text.
STRETCH = "mark boolean, key long, name long, tid long, tid2 long, place long, part binary"


class _Combiner:
    """Stretches of a task, combined by anchor and name over up to COMBINE of them.

    A name that is there several times sends one row, marked so, and the runs of all its windows.
    """

    def __init__(self):
        self.held, self.parts, self.n = [], [], 0

    def add(self, start, n, key, name, tid, known, parts: pa.Array | None = None):
        """``tid`` has a row of two numbers each; ``known`` says whether the stretch is known to repeat; ``parts`` may have its bytes."""
        self.held.append((start, n, key.view(np.int64), name.view(np.int64), tid, known))
        self.parts.append(pa.nulls(len(start), pa.binary()) if parts is None else parts)
        self.n += len(start)

    def batches(self, least: int = 1) -> Iterator[pa.RecordBatch]:
        if self.n < max(least, 1):
            return
        start, n, key, name, tid, known = (np.concatenate(x) for x in zip(*self.held, strict=True))
        parts = pa.concat_arrays(self.parts)
        self.held, self.parts, self.n = [], [], 0
        by = np.lexsort((name, key))
        start, n, key, name, tid, known = start[by], n[by], key[by], name[by], tid[by], known[by]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (name[1:] != name[:-1])])
        many = ~(new & np.concatenate([new[1:], [True]]))
        near, place = _runs(tid[many & ~known], start[many & ~known], n[many & ~known])
        some = np.maximum.reduceat(many | known, np.flatnonzero(new))
        tid = np.concatenate([tid[new], near])
        out = (
            np.concatenate([np.zeros(new.sum(), bool), np.ones(len(near), bool)]),
            np.concatenate([key[new], near[:, 0]]),
            np.concatenate([name[new], near[:, 1]]),
            tid[:, 0].copy(),
            tid[:, 1].copy(),
            np.concatenate([_packed(start, n, 0)[new] | some, place]),
        )
        first = pa.concat_arrays([parts.take(pa.array(by[new])), pa.nulls(len(near), pa.binary())])
        yield pa.RecordBatch.from_arrays([*map(pa.array, out), first], ["mark", "key", "name", "tid", "tid2", "place", "part"])


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch.column("tid").to_numpy(), batch.column("tid2").to_numpy()], axis=1)


def _find(length: int):
    """Task function over (tid, tid2, body): the stretches, combined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Combiner()
        for batch in batches:
            tids = _ids(batch)
            for buffer, first, last, owner, shift in _pieces(batch.column("body").to_pylist(), length):
                start, n, key, name = stretches(buffer, first, last, length)
                text = np.searchsorted(first, start, side="right") - 1
                found.add(start + shift[text], n, key, name, tids[owner[text]], np.zeros(len(start), bool))
                yield from found.batches(COMBINE)
        yield from found.batches()

    return run


#: What becomes of a stretch; ``part`` has its bytes, once they have been fetched.
JUDGED = "key long, tid long, tid2 long, place long, part binary, kind int"


def _judge(max_group: int):
    """Task function over stretches, sorted by mark, key and name: what becomes of each.

    kind 1: its windows repeat; 2: to be sorted; 3: to be split; 0: 2, 3 or nothing, as its key may have
    more names in other partitions. Of a name, one row is sorted or split. Unique keys vanish.
    """
    names_out = ["key", "tid", "tid2", "place", "part", "kind"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: tuple | None = None
        opened: set = set()  # keys that this partition may not have whole, or that are passed on in parts

        def judged(columns: list[np.ndarray], parts: pa.Array) -> Iterator[pa.RecordBatch]:
            key, name, tid, tid2, place = columns
            if not len(key):
                return
            new_key = np.concatenate([[True], key[1:] != key[:-1]])
            new = new_key | np.concatenate([[True], name[1:] != name[:-1]])
            of_key, of_name = np.cumsum(new_key) - 1, np.cumsum(new) - 1
            names, rows = np.bincount(of_key[new])[of_key], np.bincount(of_name)[of_name]
            known = place & 1
            repeats = (rows > 1) | (np.maximum.reduceat(known, np.flatnonzero(new)) > 0)[of_name]
            kind = np.where(np.isin(key, list(opened)), 0, np.where(names <= max_group, 2, 3))
            again, once = np.flatnonzero(repeats & (known == 0)), np.flatnonzero(new & ((names > 1) | (kind == 0)))
            at = np.concatenate([again, once])
            kinds = np.concatenate([np.ones(len(again), np.int32), kind[once].astype(np.int32)])
            held = pa.concat_arrays([pa.nulls(len(again), pa.binary()), parts.take(pa.array(once))])
            yield pa.RecordBatch.from_arrays([*(pa.array(c[at]) for c in (key, tid, tid2, place | repeats)), held, pa.array(kinds)], names_out)

        for batch in batches:
            mark = batch.column("mark").to_numpy(zero_copy_only=False)
            now, parts = [batch.column(c).to_numpy() for c in ("key", "name", "tid", "tid2", "place")], batch.column("part")
            if mark.any():
                key, _, tid, tid2, place = (c[mark] for c in now)
                yield pa.RecordBatch.from_arrays([*map(pa.array, (key, tid, tid2, place)), pa.nulls(len(key), pa.binary()), pa.array(np.ones(len(key), np.int32))], names_out)
            now, parts = [c[~mark] for c in now], parts.filter(pa.array(~mark))
            if not len(now[0]):
                continue
            if rest is None:
                opened.add(int(now[0][0]))
            else:
                now, parts = [np.concatenate(x) for x in zip(rest[0], now, strict=True)], pa.concat_arrays([rest[1], parts])
            key, name = now[0], now[1]
            last = int(np.searchsorted(key, key[-1]))
            if len(key) - last > 2 * COMBINE:  # too many to hold: pass on all but the last name
                opened.add(int(key[-1]))
                before = np.flatnonzero(name != name[-1])
                last = int(before[-1]) + 1 if len(before) else last
            yield from judged([x[:last] for x in now], parts[:last])
            opened &= {int(key[-1])}
            rest = [x[last:] for x in now], parts[last:]
        if rest is not None:
            opened.add(int(rest[0][0][-1]))
            yield from judged(*rest)

    return run


def _each_text(batches: Iterator[pa.RecordBatch]):
    """(tid, tid2, body, [(key, place)]) of every text of a task once."""
    seen: set = set()
    for batch in batches:
        for tid, tid2, body, wanted in zip(*(batch.column(c) for c in ("tid", "tid2", "body", "wanted")), strict=True):
            known = tid.as_py(), tid2.as_py()
            if known not in seen:
                seen.add(known)
                yield *known, body.as_py(), [(x["key"], x["place"]) for x in wanted.as_py()]


def _cut_out(length: int):
    """Task function over (tid, tid2, body, wanted): the bytes of the wanted stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = ([], [], [], [], []), 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in out[:4]), pa.array(out[4], pa.binary())], ["key", "tid", "tid2", "place", "part"])

        for tid, tid2, body, wanted in _each_text(batches):
            for key, place in wanted:
                start, n = place >> 20, place >> 1 & 0x7FFFF
                part = body[start : start + n + length - 1]
                for column, value in zip(out, (key, tid, tid2, place, part), strict=True):
                    column.append(value)
                size += len(part)
            if size >= CHUNK:
                yield batch()
                out, size = ([], [], [], [], []), 0
        if out[0]:
            yield batch()

    return run


def _split(length: int, step: int):
    """Task function over (key, tid, tid2, place, part): the stretches as shorter ones, with what their windows share as the anchor.

    An anchor's windows are dealt by where it lies in them, ``step`` neighbouring places to a part. All
    windows of a part share the bytes from the start of the last to the end of the first of those places.
    """

    def parts_of(stretch: list[tuple]) -> tuple:
        tid, tid2, start, n, known = (np.array(x) for x in list(zip(*stretch, strict=True))[:5])
        bodies = [x[5] for x in stretch]
        base = np.cumsum([0, *map(len, bodies)])[:-1]
        buffer = b"".join(bodies)
        hashes, second = Hashes(buffer), Hashes(buffer, 2)
        # the anchor is the smallest-hashed of the grams that all windows of the stretch have
        anchor = np.array([b + k - 1 + int((hashes.gram[b + k - 1 : b + length - GRAM + 1] & ~_LOW).argmin()) for b, k in zip(base, n, strict=True)])
        owner = np.repeat(np.arange(len(n)), n)
        at = base[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        part = (anchor[owner] - at) // step
        new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (part[1:] != part[:-1])])
        first, last, of = at[new], at[np.concatenate([new[1:], [True]])], owner[new]
        key = hashes.of(anchor[of] - part[new] * step, length - step + 1)
        cut = [buffer[x : y + length] for x, y in zip(first.tolist(), last.tolist(), strict=True)]
        names = second.names(first, last, length)
        return start[of] + first - base[of], last - first + 1, key, names, np.stack([tid, tid2], axis=1)[of], known[of], pa.array(cut, pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held, size = _Combiner(), [], 0
        for batch in batches:
            for tid, tid2, place, part in zip(*(batch.column(c).to_pylist() for c in ("tid", "tid2", "place", "part")), strict=True):
                held.append((tid, tid2, place >> 20, place >> 1 & 0x7FFFF, bool(place & 1), part))
                size += len(part)
                if size >= PIECE:
                    found.add(*parts_of(held))
                    held, size = [], 0
                    yield from found.batches(COMBINE // 16)
        if held:
            found.add(*parts_of(held))
        yield from found.batches()

    return run


def _sort_windows(length: int):
    """Task function over (key, tid, tid2, place, part), sorted by key: runs of windows that repeat, for stretches not known to."""

    def sorted_out(tids, tids2, places, parts) -> pa.RecordBatch:
        starts_of = np.cumsum([0, *map(len, parts)])[:-1]
        place = np.array(places, np.int64)
        n = place >> 1 & 0x7FFFF
        owner = np.repeat(np.arange(len(parts)), n)
        inner = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        order, equal = deep_shallow_sort(b"".join(parts), starts_of[owner] + inner, length)
        again = np.zeros(len(owner), bool)
        again[order] = equal | np.concatenate([equal[1:], [False]])
        at = np.flatnonzero(again & ((place & 1) == 0)[owner])
        if len(at):
            new = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]])])
            first, last = at[new], at[np.concatenate([new[1:], [True]])]
        else:
            first = last = at
        found = _packed((place >> 20)[owner[first]] + inner[first], last - first + 1, 0)
        ids = [pa.array(np.array(x, np.int64)[owner[first]]) for x in (tids, tids2)]
        return pa.RecordBatch.from_arrays([*ids, pa.array(found)], ["tid", "tid2", "place"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, last = [], 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= CHUNK and row[0] != last:
                    yield sorted_out(*zip(*(r[1:] for r in rows), strict=True))
                    rows, size = [], 0
                rows.append(row)
                size += len(row[4])
                last = row[0]
        if rows:
            yield sorted_out(*zip(*(r[1:] for r in rows), strict=True))

    return run


def _remove(length: int, keep_text: bool):
    """Task function over (doc_id, body, places): what is left of each text."""

    def one(body: bytes, places) -> tuple:
        if places is None:
            return [], body
        place = np.sort(np.array(places, np.int64))
        start, n = place >> 20, place >> 1 & 0x7FFFF
        end = np.minimum(np.maximum.accumulate(start + n + length - 1), len(body))
        new = np.concatenate([[True], start[1:] > end[:-1]])
        first, last = start[new].tolist(), end[np.concatenate([new[1:], [True]])].tolist()
        kept = b"".join(body[a:b] for a, b in zip([0, *last], [*first, len(body)], strict=True))
        return [{"start": a, "end": b} for a, b in zip(first, last, strict=True)], kept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = batch.column("body").to_pylist()
            done = [one(b, p) for b, p in zip(bodies, batch.column("places").to_pylist(), strict=True)]
            spans = pa.array([s for s, _ in done], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(list(map(len, bodies)), pa.int64()), spans,
                    pa.array([hashlib.sha256(k).hexdigest() for _, k in done]), pa.array([k if keep_text else None for _, k in done], pa.binary()),
                ],
                ["doc_id", "n_bytes", "spans", "kept_sha256", "kept"],
            )

    return run


def remove_repeats(
    docs: DataFrame, *, length: int = 200, max_group: int = MAX_GROUP, keep_text: bool = True, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_bytes, spans (removed runs, array<struct<start, end>> in bytes), kept_sha256, kept (binary).

    ``length`` is 128 to 8192. A null text is empty; texts shorter than ``length`` stay whole; of texts that
    are repeated rows, all copies are removed (each is repeated elsewhere); strings never cross rows. A text
    of any length is worked on whole, in pieces. Ids are of any type and may be null or repeated; an empty
    table gives an empty result; other columns are not read. Texts and stretches are known by 128-bit
    hashes while they are worked on; which windows of stretches that differ are equal, the sort says.

    Shuffled are: hashes of stretches (about 2 rows for 100 bytes), combined in each task first, so that a
    copied text or line costs a row a task; the texts once, by hash (used twice); the bytes of stretches
    whose anchor has differing ones. An anchor with more than ``max_group`` of those is split by longer
    strings, and a text with very many copies has them in several tasks. What is found between steps goes to
    the shared checkpoint folder.
    """
    if not 2 * GRAM <= length <= 8192:
        raise ValueError("length must be 128 to 8192")
    plain = common.text_bytes(docs, id_col, text_col).withColumn("tid", F.xxhash64("body")).withColumn("tid2", F.xxhash64(F.lit(1), "body"))
    found = plain.select("tid", "tid2", "body").where(F.octet_length("body") >= length).mapInArrow(_find(length), STRETCH)
    ids, marks, most = ["tid", "tid2"], None, max(COPIES, docs.count() // 10_000)
    # texts with more copies than ``most``, 10,000 texts at most, have a salt, so that their copies are dealt out
    counted = plain.groupBy(*ids).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
    crowds = common.cut(counted.select(*ids, F.ceil(F.col("n") / most).alias("salts")))
    salt = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("salts")), F.lit(0)).alias("salt")
    texts = plain.join(F.broadcast(crowds), ids, "left").select("doc_id", *ids, "body", salt)
    part = "key long, tid long, tid2 long, place long, part binary"

    def fetched(rows: DataFrame) -> DataFrame:
        """``rows`` with the bytes of the stretches."""
        # doc_id goes along, and salt 0 isn't a literal, so that all uses of the texts read the same shuffle
        wanted = rows.groupBy(*ids).agg(F.collect_set(F.struct("key", "place")).alias("wanted"), F.min(F.col("place") * 0).alias("salt"))
        return texts.join(wanted.hint("shuffle_hash"), [*ids, "salt"]).select("doc_id", *ids, "salt", "body", "wanted").mapInArrow(_cut_out(length), part)

    def fetched_few(rows: DataFrame) -> DataFrame:
        """The same of a few stretches: their texts are sought where they are."""
        if rows.count() > SOUGHT:
            return fetched(rows)
        wanted = rows.groupBy(*ids).agg(F.collect_set(F.struct("key", "place")).alias("wanted"))
        return plain.join(F.broadcast(wanted), ids).select(*ids, "body", "wanted").mapInArrow(_cut_out(length), part).dropDuplicates(["key", *ids, "place"])

    for level, step in enumerate((*STEPS, None)):
        least = max_group if step else 1 << 62
        dealt = found.repartitionByRange("key", "name").sortWithinPartitions("mark", "key", "name")
        judged = common.cut(dealt.mapInArrow(_judge(least), JUDGED))
        names = judged.where("kind = 0").groupBy("key").agg(F.count(F.lit(1)).alias("names")).where("names > 1")
        # names has the keys at the ends of partitions: two a partition at most, and those passed on in parts
        parted = judged.where("kind = 0").drop("kind").join(F.broadcast(names), "key").withColumn("kind", F.when(F.col("names") <= least, 2).otherwise(3))
        whole = judged.where("kind > 1").unionByName(parted.drop("names"))
        to_sort, to_split = (whole.where(F.col("kind") == k).drop("kind") for k in (2, 3))
        by_sort = (
            (to_sort if level else fetched(to_sort.drop("part")))
            .repartition("key")
            .sortWithinPartitions("key")
            .mapInArrow(_sort_windows(length), "tid long, tid2 long, place long")
        )
        more = judged.where("kind = 1").select(*ids, "place").unionByName(by_sort)
        marks = more if marks is None else marks.unionByName(more)
        if step is None or to_split.isEmpty():
            break
        found = common.cut(to_split if level else fetched_few(to_split.drop("part"))).mapInArrow(_split(length, step), STRETCH)
    clean = F.shiftleft(F.shiftright("place", 1), 1)
    places = marks.groupBy(*ids).agg(F.collect_set(clean).alias("places")).join(F.broadcast(crowds), ids, "left")
    places = places.select(*ids, "places", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
    joined = texts.join(places.hint("shuffle_hash"), [*ids, "salt"], "left").select("doc_id", *ids, "salt", "body", "places")
    return joined.mapInArrow(
        _remove(length, keep_text), f"{common.typed(plain, 'doc_id')}, n_bytes long, spans array<struct<start long, end long>>, kept_sha256 string, kept binary"
    )
