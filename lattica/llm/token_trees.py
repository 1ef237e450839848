"""Token counts under edits: a segment tree of pre-token pieces for each document.

A leaf holds some consecutive pieces; every node keeps the characters and tokens
below it. An edit is found by descending on characters. Only the pieces it
touches and one piece of context on either side are cut and encoded again, and
the sums on the way up are corrected; all other counts stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime, vocab

LEAF_PIECES = 32


class Tree:
    """Pieces of one text, in leaves, with sums of characters and tokens."""

    def __init__(self, text: str, encoder: vocab.Encoder, leaf: int = LEAF_PIECES):
        self.encoder = encoder
        pieces = encoder.pieces(text)
        self.leaves = [pieces[i : i + leaf] for i in range(0, len(pieces), leaf)] or [[]]
        encoder.encode_cut([text])
        self.counts = [list(map(self._count, part)) for part in self.leaves]
        self.width = 1 << (len(self.leaves) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        for i, (part, count) in enumerate(zip(self.leaves, self.counts)):
            self.chars[self.width + i], self.tokens[self.width + i] = sum(map(len, part)), sum(count)
        for i in range(self.width - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]
        #: Pieces encoded for edits so far.
        self.encoded = 0

    def _count(self, piece: str) -> int:
        return len(self.encoder.cache[piece]) // 4

    @property
    def total(self) -> int:
        return self.tokens[1]

    def _at(self, place: int) -> tuple[int, int, int]:
        """Leaf and piece that hold the character at ``place``, and where that piece starts."""
        node, start = 1, 0
        place = min(place, max(0, self.chars[1] - 1))
        while node < self.width:
            node *= 2
            if place - start >= self.chars[node]:
                start += self.chars[node]
                node += 1
        leaf = node - self.width
        for k, piece in enumerate(self.leaves[leaf]):
            if place < start + len(piece):
                return leaf, k, start
            start += len(piece)
        return leaf, max(0, len(self.leaves[leaf]) - 1), start - (len(self.leaves[leaf][-1]) if self.leaves[leaf] else 0)

    def edit(self, start: int, end: int, new: str) -> int:
        """Put ``new`` in place of the characters from ``start`` to ``end``; returns the new total."""
        size = self.chars[1]
        start = min(max(0, start), size)
        end = min(max(start, end), size)
        leaf, k, at = self._at(max(0, start - 1))
        if k:  # one piece of context before the touched one
            k -= 1
            at -= len(self.leaves[leaf][k])
        else:
            prior = leaf - 1
            while prior >= 0 and not self.leaves[prior]:
                prior -= 1
            if prior >= 0:
                leaf, k = prior, len(self.leaves[prior]) - 1
                at -= len(self.leaves[leaf][k])
        last, m, _ = self._at(end)
        for _ in range(1):  # and one after
            if m + 1 < len(self.leaves[last]):
                m += 1
            else:
                after = last + 1
                while after < len(self.leaves) and not self.leaves[after]:
                    after += 1
                if after < len(self.leaves):
                    last, m = after, 0
        if leaf == last:
            old = self.leaves[leaf][k : m + 1]
        else:
            old = self.leaves[leaf][k:] + [p for part in self.leaves[leaf + 1 : last] for p in part] + self.leaves[last][: m + 1]
        text = "".join(old)
        pieces = self.encoder.pieces(text[: start - at] + new + text[end - at :])
        self.encoder.encode_cut([text[: start - at] + new + text[end - at :]])
        self.encoded += len(pieces)
        counts = list(map(self._count, pieces))
        tail, tail_counts = (self.leaves[last][m + 1 :], self.counts[last][m + 1 :])
        if leaf == last:
            self.leaves[leaf][k:], self.counts[leaf][k:] = pieces + tail, counts + tail_counts
        else:
            self.leaves[leaf][k:], self.counts[leaf][k:] = pieces, counts
            for i in range(leaf + 1, last):
                self.leaves[i], self.counts[i] = [], []
            self.leaves[last], self.counts[last] = tail, tail_counts
        for i in range(leaf, last + 1):
            self._set(i)
        return self.total

    def _set(self, leaf: int) -> None:
        node = leaf + self.width
        more_chars = sum(map(len, self.leaves[leaf])) - self.chars[node]
        more_tokens = sum(self.counts[leaf]) - self.tokens[node]
        while node:
            self.chars[node] += more_chars
            self.tokens[node] += more_tokens
            node //= 2

    def text(self) -> str:
        return "".join(p for part in self.leaves for p in part)


def counted(docs: DataFrame, edits: str, tokenizer: str, drops_space: bool = False) -> DataFrame:
    """Token counts before and after edits.

    ``docs`` has ``doc_id``, ``text`` and in column ``edits`` an array of
    ``(start, end, new)`` in characters, each on the text that the one before
    left; places beyond the text mean its end. Null text is empty, null edits
    are none, a null ``new`` deletes. Rows stand alone.
    """

    runtime.prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = vocab.encoder(tokenizer, drops_space)
        for batch in batches:
            rows = []
            for text, steps in zip(batch.column("text").fill_null("").to_pylist(), batch.column("edits").to_pylist()):
                tree = Tree(text, encoder)
                before, pieces = tree.total, sum(map(len, tree.leaves))
                for s in steps or ():
                    tree.edit(s["start"] or 0, s["end"] or 0, s["new"] or "")
                rows.append((before, tree.total, pieces, tree.encoded))
            table = np.array(rows, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c) for c in table.T)], ["doc_id", "n_tokens", "n_tokens_edited", "n_pieces", "n_reencoded"])

    return docs.select(F.col("doc_id").cast("long"), "text", F.col(edits).alias("edits")).mapInArrow(runtime.trimmed(run), "doc_id long, n_tokens long, n_tokens_edited long, n_pieces long, n_reencoded long")
