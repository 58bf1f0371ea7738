"""Hierarchical multi-length packing of token sequences.

Inside each task the documents are tokenised once and packed block by block. Whole windows of the longest context go
straight to the top tier; what remains of a document is routed to the shortest tier that holds it. Tiers are packed
from the longest down: a sequence starts with the longest waiting remainder, its gap takes the longest shorter pieces
that fit, and a last gap is closed by cutting a piece of the shortest tier. What does not fill a sequence waits for
the next block; at the end of a task the rest is cut at powers of two, so no sequence is padded. Sequences of a tier
form step groups of equal token budget.

No shuffle: a task packs what it reads, so memory is bounded by a block plus one document, and a lost task is redone
alone. Sequence ids hold the partition number and are unique over the table. Null texts are empty and keep their end
token; repeated rows are packed again; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import itertools
import re
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterable, Iterator
from functools import cached_property
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from drawloom.llm.common import release_memory

if TYPE_CHECKING:
    from tokenizers import Tokenizer

TIERS = (2048, 1024, 512, 256)
BLOCK_TOKENS = 1 << 20
STEP_TOKENS = 1 << 14
MEMO = 50_000
BATCH_CHARS = 1 << 17
PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "sequence_tokens long, tier long, step_group long"
)
#: Letters whose classes all versions of Unicode agree on; other texts go through the reference tokenizer itself.
_PLAIN = re.compile("[^\x00-ԯ -⁯]")
_ENCODERS: dict[tuple[str, str], Encoder] = {}


class Encoder:
    """Ids of the public byte-level vocabulary. The ranks file is the same vocabulary in a faster library.

    What lies between two single spaces, with the first of them, is tokenised alike in any text, so its ids are remembered (up to ``MEMO`` pieces a worker).
    """

    def __init__(self, vocabulary: str, ranks: str) -> None:
        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as lines:
            table = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.opens = np.zeros(max(table.values()) + 1, bool)
        self.opens[[rank for token, rank in table.items() if token[:1] == b" "]] = True
        self.vocabulary = vocabulary
        self.memo: dict[str, bytes] = {}

    @cached_property
    def slow(self) -> Tokenizer:
        """The reference tokenizer, for texts that are not plain; a worker that meets none does not hold it."""
        from tokenizers import Tokenizer

        slow = Tokenizer.from_file(self.vocabulary)
        slow.encode_special_tokens = True
        return slow

    def batch(self, whole: list[str]) -> list[np.ndarray]:
        """Ids of some texts. Their pieces that are not remembered are tokenised in one go."""
        get = self.memo.get
        split = [t.split(" ") if len(t) >= 64 and plain(t) else None for t in whole]
        found = [list(map(get, words[1:])) if words else [] for words in split]
        missing: set[str] = set()
        for k, (words, ids) in enumerate(zip(split, found, strict=True)):
            if None in ids:
                own = {w for w, known in zip(words[1:], ids, strict=True) if known is None}
                if any(not w or w[0].isspace() for w in own):  # white space in a row: only the whole text is safe
                    split[k] = None
                else:
                    missing |= own
        new = list(missing)
        extra = self.fresh(new) if new else {}
        encoded = []
        for text, words, ids in zip(whole, split, found, strict=True):
            if words is None:
                encoded.append(self.whole(text))
            else:
                if None in ids:
                    ids = [extra[w] if known is None else known for w, known in zip(words[1:], ids, strict=True)]
                first = np.array(self.fast.encode_ordinary(words[0]), "<u4").tobytes()
                encoded.append(np.frombuffer(first + b"".join(ids), "<u4"))
        for w in itertools.islice(new, max(0, MEMO - len(self.memo))):
            if len(w) < 40:
                self.memo[w] = extra[w]
        return encoded

    def fresh(self, words: list[str]) -> dict[str, bytes]:
        ids = self.fast.encode_to_numpy(" " + " ".join(words), disallowed_special=())
        cuts = np.append(np.flatnonzero(self.opens[ids]), len(ids)) * 4
        if len(cuts) != len(words) + 1:  # a piece opens with a space inside
            return {w: np.array(self.fast.encode_ordinary(" " + w), "<u4").tobytes() for w in words}
        raw, cuts = ids.astype("<u4").tobytes(), cuts.tolist()
        return {w: raw[a:b] for w, a, b in zip(words, cuts, cuts[1:], strict=False)}

    def whole(self, text: str) -> np.ndarray:
        if not plain(text):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.fast.encode_ordinary(text), np.uint32)


def plain(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
        return True
    except UnicodeEncodeError:
        return not _PLAIN.search(text)


def encoder(vocabulary: str, ranks: str) -> Encoder:
    if (vocabulary, ranks) not in _ENCODERS:
        _ENCODERS[vocabulary, ranks] = Encoder(vocabulary, ranks)
    return _ENCODERS[vocabulary, ranks]


class Packer:
    """Packs the documents of one task. A waiting piece is (document number, start, length)."""

    def __init__(self, partition: int, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS) -> None:
        assert tiers == tuple(sorted(tiers, reverse=True)) and all(t & (t - 1) == 0 for t in tiers)
        self.tiers, self.step_tokens, self.base = tiers, step_tokens, partition << 40
        self.by_length: dict[int, list[tuple[int, int]]] = {}
        self.lengths: list[int] = []
        self.waiting = 0
        self.sequences = 0
        self.in_tier = dict.fromkeys(tiers, 0)
        self.out: list[tuple[int, int, int, int, int, int, int, int]] = []

    def add(self, doc: int, n: int) -> None:
        """Whole windows are sequences of their own; the remainder waits in its tier."""
        top, start = self.tiers[0], 0
        while n - start >= top:
            self.close([(doc, start, top)], top)
            start += top
        if n > start:
            self.push(doc, start, n - start)

    def push(self, doc: int, start: int, length: int) -> None:
        if length not in self.by_length:
            self.by_length[length] = []
            insort(self.lengths, length)
        self.by_length[length].append((doc, start))
        self.waiting += length

    def pop(self, length: int) -> tuple[int, int]:
        piece = self.by_length[length].pop()
        if not self.by_length[length]:
            del self.by_length[length]
            self.lengths.remove(length)
        self.waiting -= length
        return piece

    def fill(self, size: int) -> None:
        """One full sequence of ``size`` tokens, longest pieces first, the last gap by a cut of a short piece."""
        pieces, gap = [], size
        while gap:
            k = bisect_right(self.lengths, gap)
            length = self.lengths[k - 1] if k else self.lengths[0]
            doc, start = self.pop(length)
            taken = min(length, gap)
            pieces.append((doc, start, taken))
            if taken < length:
                self.push(doc, start + taken, length - taken)
            gap -= taken
        self.close(pieces, size)

    def pack(self) -> None:
        """Full sequences from the longest tier down, as long as a longest window could still be filled."""
        top = self.tiers[0]
        while self.waiting >= top:
            longest = self.lengths[-1]
            tier = min(t for t in self.tiers if t >= longest)
            self.fill(tier)

    def finish(self) -> None:
        self.pack()
        while self.waiting:
            self.fill(1 << (self.waiting.bit_length() - 1))

    def close(self, pieces: list[tuple[int, int, int]], size: int) -> None:
        sequence, offset = self.base + self.sequences, 0
        self.sequences += 1
        tier = min((t for t in self.tiers if t >= size), default=size)
        group = self.in_tier[tier] * tier // self.step_tokens
        self.in_tier[tier] += 1
        step = self.base + (self.tiers.index(tier) << 36) + group
        for doc, start, length in pieces:
            self.out.append((doc, start, length, sequence, offset, size, tier, step))
            offset += length


def encoded(batch: pa.RecordBatch, encode: Encoder) -> Iterator[tuple[int | None, np.ndarray]]:
    """Ids by document, a few texts at a time (about ``BATCH_CHARS``)."""
    ids, held, size = [], [], 0
    last = batch.num_rows - 1
    for k, (doc_id, text) in enumerate(zip(batch.column("doc_id"), batch.column("text"), strict=True)):
        ids.append(doc_id.as_py())
        held.append(text.as_py() or "")
        size += len(held[-1])
        if size >= BATCH_CHARS or k == last:
            yield from zip(ids, encode.batch(held), strict=True)
            ids, held, size = [], [], 0


def pack(docs: DataFrame, vocabulary: str, ranks: str, end_id: int = 1, tiers: tuple[int, ...] = TIERS, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Pieces of all documents (``PIECES``): each id of a document lies in exactly one of them."""
    names = [c.split()[0] for c in PIECES.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from packed(batches)
        finally:  # the vocabularies and the memo are not kept by an idle worker
            _ENCODERS.clear()
            release_memory()

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(vocabulary, ranks), Packer(TaskContext.get().partitionId(), tiers)
        held: dict[int, tuple[int | None, np.ndarray]] = {}
        number = fresh = 0

        def rows() -> pa.RecordBatch | None:
            out, packer.out = packer.out, []
            crcs = [zlib.crc32(held[doc][1][start : start + length]) for doc, start, length, *_ in out]
            columns = [[held[r[0]][0] for r in out], [r[1] for r in out], [r[2] for r in out], crcs, [len(held[r[0]][1]) for r in out], *([r[k] for r in out] for k in (3, 4, 5, 6, 7))]
            alive = {doc for pieces in packer.by_length.values() for doc, _ in pieces}
            for doc in [d for d in held if d not in alive]:
                del held[doc]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names) if out else None

        for batch in batches:
            for doc_id, ids in encoded(batch, encode):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                held[number] = doc_id, ids
                packer.add(number, len(ids))
                number, fresh = number + 1, fresh + len(ids)
                if fresh >= block_tokens:
                    packer.pack()
                    fresh = 0
                    if (out := rows()) is not None:
                        yield out
        packer.finish()
        if (out := rows()) is not None:
            yield out

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)
