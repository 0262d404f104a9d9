"""Token counts by greedy longest-match word pieces, without building the pieces.

The vocabulary becomes a trie. Every node has a failure link and the number of pieces that are popped
when the link is followed, so a word of n bytes takes O(n) steps whatever the pieces are: no byte is
read twice. A link says: the longest match from here is known, go on as if the word had started after
it.
"""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

#: Words kept in a task's memo, and the longest that is kept; longer ones are counted anew each time.
MEMO_WORDS, MEMO_BYTES = 400_000, 48


class Automaton:
    """Greedy longest-match counter for one vocabulary of byte strings.

    ``mark`` stands before every word (the vocabulary's own sign for a word's start; may be empty). A
    word that no sequence of greedy pieces covers counts as one unknown token.
    """

    ROOT, NONE = 0, -1

    def __init__(self, pieces: Iterable[bytes], mark: bytes = b" "):
        self.mark = mark
        self.edges: dict[int, int] = {}
        ends, byte_of, parent_of = [False], [0], [0]
        for piece in pieces:
            node = self.ROOT
            for byte in piece:
                slot = node << 8 | byte
                child = self.edges.get(slot)
                if child is None:
                    child = self.edges[slot] = len(ends)
                    ends.append(False)
                    byte_of.append(byte)
                    parent_of.append(node)
                node = child
            ends[node] |= node != self.ROOT
        self.link = [self.NONE] * len(ends)
        self.pops = [0] * len(ends)
        self._build_links(ends, byte_of, parent_of)

    def _build_links(self, ends, byte_of, parent_of) -> None:
        children = [[] for _ in ends]
        for node in range(1, len(ends)):
            children[parent_of[node]].append(node)
        waiting = deque(children[self.ROOT])
        while waiting:
            node = waiting.popleft()
            waiting.extend(children[node])
            if ends[node]:  # the whole path is a piece: pop it and start afresh
                self.link[node], self.pops[node] = self.ROOT, 1
                continue
            above = parent_of[node]
            popped, at = self.pops[above], self.link[above]
            while at != self.NONE and (at << 8 | byte_of[node]) not in self.edges:
                popped, at = popped + self.pops[at], self.link[at]
            if at != self.NONE:
                self.link[node], self.pops[node] = self.edges[at << 8 | byte_of[node]], popped

    def count(self, word: bytes) -> int:
        """Greedy pieces of ``mark + word``; 1 if they don't cover it."""
        edges, link, pops, node, found = self.edges, self.link, self.pops, self.ROOT, 0
        for byte in self.mark + word:
            while (child := edges.get(node << 8 | byte)) is None:
                found += pops[node]
                node = link[node]
                if node < 0:
                    return 1
            node = child
        while node:
            found += pops[node]
            node = link[node]
            if node < 0:
                return 1
        return found


def read_ranks(path: str) -> list[bytes]:
    """The pieces of a file of lines ``base64 rank``, read on the driver."""
    with open(path, "rb") as lines:
        return [base64.b64decode(line.split()[0]) for line in lines if line.strip()]


def token_counts(
    docs: DataFrame, pieces: Iterable[bytes], *, mark: bytes = b" ", id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_bytes, n_words, n_tokens of every row's whole text.

    Words are runs of anything but ASCII white space. A null or empty text has 0 of each; a text or word of
    any length is counted whole; ids are of any type and may be null; repeated rows are counted each for itself; an empty table gives an empty result; other columns of ``docs`` are not
    read. The compiled vocabulary is broadcast: its size is that of the vocabulary file, whatever the
    corpus. Narrow: no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Automaton(pieces, mark))

    def make():
        automaton, memo = shared.value, {}

        def tokens(words: list[bytes]) -> int:
            total = 0
            for word in words:
                n = memo.get(word)
                if n is None:
                    n = automaton.count(word)
                    if len(word) <= MEMO_BYTES:
                        if len(memo) >= MEMO_WORDS:
                            memo.clear()
                        memo[word] = n
                total += n
            return total

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            n_bytes, n_words, n_tokens = [], [], []
            for body in batch.column("body"):
                text = body.as_py()
                words = text.split()
                n_bytes.append(len(text))
                n_words.append(len(words))
                n_tokens.append(tokens(words))
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n_bytes, n_words, n_tokens))],
                ["doc_id", "n_bytes", "n_words", "n_tokens"],
            )

        return apply

    rows = common.text_bytes(docs, id_col, text_col)
    return common.map_batches(rows, make, f"{common.typed(rows, 'doc_id')}, n_bytes long, n_words long, n_tokens long")
