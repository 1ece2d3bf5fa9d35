"""Token counts of documents under edits: a segment tree of pre-token parts per document, re-encoded only where edits touch.

A text is cut into parts where byte-level BPE never merges over: before a blank between two visible characters, and before
and after a line feed between two. Whether it may be cut at a place is told by that place's two neighbours alone, so an edit
can only move cuts next to it. The tree's leaves hold the characters and tokens of each part, its inner nodes their sums.
An edit takes the leaves it touches and those of the two characters on either side (boundary context), encodes their new text,
puts its parts back as leaves, and updates the sums above. All other parts keep their counts, and so an edit recounts little
however many came before it.

Nulls, empties, ties: a null text is empty and has no token; edits of it beyond its end insert at the end. Edits are given in
places of the text as it was; they apply from the last to the first, and one that overlaps a later one is cut to what is
left before it. A null or empty list of edits changes nothing. Other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, prepare
from .tokens import CachedEncoder, encoder

#: Parts of a text whose sums make one leaf of the tree of sums.
BLOCK = 64
_VISIBLE = "!-~¡-˿Ͱ-ᙿ"
_CUT = re.compile(f"(?<=[{_VISIBLE}])[ \n](?=[{_VISIBLE}])")


def parts(text: str) -> list[str]:
    """The text in parts that are encoded apart; together they are the text."""
    at = [0]
    for m in _CUT.finditer(text):
        at.append(m.start())
        if m.group() == "\n":
            at.append(m.end())
    at.append(len(text))
    return [text[a:b] for a, b in zip(at[:-1], at[1:], strict=True) if b > a]


def _levels(leaves: np.ndarray) -> list[np.ndarray]:
    out = [leaves]
    while len(out[-1]) > 1:
        x = out[-1]
        out.append(np.add.reduceat(x, np.arange(0, len(x), 2)))
    return out


class CountTree:
    """Tokens of a text under edits.

    Parts lie in blocks of BLOCK to 2 * BLOCK (the last may hold fewer); a binary tree of sums stands above the blocks. An edit
    changes some parts of a block and the sums on the way up; the tree is only made anew where a block is split or emptied.
    """

    def __init__(self, text: str, coder: CachedEncoder, cut: list[str] | None = None):
        self.coder, self.recounted = coder, 0
        cut = parts(text) if cut is None else cut
        counts = self.counts(cut)
        at = range(0, max(1, len(cut)), BLOCK)
        self.parts = [cut[k : k + BLOCK] for k in at]
        self.tokens = [counts[k : k + BLOCK] for k in at]
        self.sizes = [list(map(len, x)) for x in self.parts]
        self._build()

    def _build(self) -> None:
        self.char_sums = _levels(np.fromiter(map(sum, self.sizes), np.int64, len(self.sizes)))
        self.token_sums = _levels(np.fromiter(map(sum, self.tokens), np.int64, len(self.tokens)))

    def counts(self, cut: list[str]) -> list[int]:
        known = self.coder.known
        self.coder.learn(set(cut))
        return [len(known[p]) >> 2 for p in cut]

    @property
    def total(self) -> int:
        return int(self.token_sums[-1][0])

    def find(self, place: int) -> tuple[int, int, int]:
        """Block and number of the part that holds the character at a place (past the end: the last part), and the part's first place."""
        block, first = 0, 0
        for level in reversed(self.char_sums[:-1]):
            block *= 2
            if block + 1 < len(level) and place >= first + level[block]:
                first += int(level[block])
                block += 1
        sizes, k = self.sizes[block], 0
        while k + 1 < len(sizes) and place >= first + sizes[k]:
            first += sizes[k]
            k += 1
        return block, k, first

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace the characters from start to end.

        Whether a text is cut at a place depends on the characters next to it, so what can change are the parts that hold the
        two characters before the edit and the two behind it, and those between.
        """
        size = int(self.char_sums[-1][0])
        start, end = min(start, size), min(max(start, end), size)
        a, i, first = self.find(max(0, start - 2))
        b, j, _ = self.find(end + 1)
        old = "".join(self.parts[a][i : j + 1] if a == b else [*self.parts[a][i:], *(p for x in self.parts[a + 1 : b] for p in x), *self.parts[b][: j + 1]])
        cut = parts(old[: start - first] + new + old[end - first :])
        self.recounted += len(cut)
        counts = self.counts(cut)
        for held, fresh in ((self.parts, cut), (self.tokens, counts), (self.sizes, list(map(len, cut)))):
            held[a : b + 1] = [held[a][:i] + fresh + held[b][j + 1 :]]
        if a != b or not self.parts[a] or len(self.parts[a]) > 2 * BLOCK:
            for held in (self.parts, self.tokens, self.sizes):
                x = held[a]
                held[a : a + 1] = [x[k : k + BLOCK] for k in range(0, len(x), BLOCK)] if len(x) > 2 * BLOCK else [x] if x or len(held) == 1 else []
            self._build()
            return
        for levels, held in ((self.char_sums, self.sizes), (self.token_sums, self.tokens)):
            change, k = sum(held[a]) - int(levels[0][a]), a
            for level in levels:
                level[k] += change
                k >>= 1

    @property
    def text(self) -> str:
        return "".join(p for x in self.parts for p in x)


def apply_edits(tree: CountTree, edits: list[tuple[int, int, str]]) -> None:
    limit = None
    for start, end, new in sorted(edits, reverse=True):
        end = end if limit is None else min(end, limit)
        tree.edit(start, max(start, end), new)
        limit = start


def count_edited(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Rows (doc_id, n_tokens, n_tokens_edited, n_parts, n_recounted) of docs (doc_id, text, edits).

    edits is array<struct<start, end, new>>; tokenizer a byte-level BPE file of the tokenizers library.
    """
    prepare(docs.sparkSession)

    def count(batches: Batches) -> Batches:
        for batch in batches:
            coder, rows = encoder(tokenizer, "byte"), []
            for text, edits in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                coder.trim()
                tree = CountTree(text or "", coder, coder.parts(text or ""))
                before, n = tree.total, sum(map(len, tree.parts))
                apply_edits(tree, [(e["start"], e["end"], e["new"] or "") for e in edits or []])
                rows.append((before, tree.total, n, tree.recounted))
            columns = [pa.array(list(c), pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 4
            yield pa.record_batch([batch.column(0), *columns], ["doc_id", "n_tokens", "n_tokens_edited", "n_parts", "n_recounted"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("edits").cast("array<struct<start:bigint,end:bigint,new:string>>"))
    return rows.mapInArrow(count, "doc_id long, n_tokens long, n_tokens_edited long, n_parts long, n_recounted long")


#: Numbers and addresses that the query's edits mask: runs of nine digits or more with blanks, signs and brackets between, and e-mail addresses.
PRIVATE = re.compile(r"(?<![0-9])[0-9](?:[ ()-]{0,2}[0-9]){8,}|(?<![A-Za-z0-9._+-])[A-Za-z0-9._+-]+@[A-Za-z0-9.-]+")


def masking_edits(docs: DataFrame, mask: str = "[MASK]") -> DataFrame:
    """docs (doc_id, text) with a column of edits that mask what PRIVATE matches."""
    prepare(docs.sparkSession)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("new", pa.string())]))

    def find(batches: Batches) -> Batches:
        for batch in batches:
            edits = [[{"start": m.start(), "end": m.end(), "new": mask} for m in PRIVATE.finditer(t or "")] for t in batch.column(1).to_pylist()]
            yield pa.record_batch([*batch.columns, pa.array(edits, kind)], ["doc_id", "text", "edits"])

    return docs.select("doc_id", "text").mapInArrow(find, "doc_id long, text string, edits array<struct<start:bigint,end:bigint,new:string>>")
