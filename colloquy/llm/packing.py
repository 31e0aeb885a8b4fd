"""Best-fit packing of documents into training sequences by the sum-of-squares rule.

A document becomes its token ids and one end id. Only documents longer than a sequence are cut. Every
piece goes to the open sequence after which the squared counts of open sequences, per gap that is left,
add up to the least; opening a new sequence competes on the same terms. Pieces are dealt to groups of a
bounded number by hash, so a group is packed in one task however large the corpus is, and no source or
length can make one group large; a group leaves a few sequences part-filled, a share that does not grow.
"""

from __future__ import annotations

import math
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import kept, map_rows, settle, typed

SEQUENCE = 2048
END_ID = 0
#: Pieces of a packing group, about. It bounds the memory of a packing task.
GROUP = 25_000
#: Bytes that a worker's encoded words take, about; with more it forgets them. A chunk of over LONG characters is not kept.
KEPT_BYTES, LONG = 144 << 20, 256
#: What a kept word takes besides its characters and ids: two objects' heads and its place in the table.
OVERHEAD = 190
#: Chunks that are encoded together: what the tokenizer returns for one is many times its size.
BATCH = 1000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class WordCache(dict):
    """Token ids of white-space-free chunks, as little-endian unsigned 32-bit bytes.

    The vocabulary's normaliser and splitter never join characters across ASCII white space, so a text's
    ids are those of its chunks in order. Chunks are encoded in batches, each once.
    """

    def __init__(self, path: str):
        super().__init__()
        self.size = 0
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        suffix = self.tokenizer.model.end_of_word_suffix
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.last[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(suffix)]] = True
        self.tail = {t: np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in TAILS}

    def keep(self, chunk: str, ids: bytes) -> None:
        self[chunk] = ids
        self.size += OVERHEAD + len(chunk) + len(ids)

    def learn(self, chunks: set[str]) -> dict[str, bytes]:
        """The ids of chunks too long to be kept; those of all others are kept."""
        new = [c for c in chunks if c not in self]
        if self.size > KEPT_BYTES:
            self.clear()
            self.size = 0
            new = list(chunks)
        lowered = {c: lower(c) for c in new if len(c) <= LONG}
        words = {c[:-1] if c[-1:] in TAILS else c for c in lowered.values()}
        self.words([w for w in words if w not in self and is_word(w)])
        rest = set()
        for chunk in lowered.values():
            if chunk not in self:
                if chunk[-1:] in TAILS and chunk[:-1] in self and is_word(chunk[:-1]):
                    self.keep(chunk, self[chunk[:-1]] + self.tail[chunk[-1]])
                else:
                    rest.add(chunk)
        others = list(rest)
        for at in range(0, len(others), BATCH):
            part = others[at : at + BATCH]
            for chunk, got in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                self.keep(chunk, np.array(got.ids, "<u4").tobytes())
        for chunk, small in lowered.items():
            if chunk not in self:
                self.keep(chunk, self[small])
        return {c: np.array(self.tokenizer.encode(c, add_special_tokens=False).ids, "<u4").tobytes() for c in new if len(c) > LONG}

    def words(self, new: list[str]) -> None:
        """Chunks of letters alone are one word each; its last token, and no other, ends a word."""
        for at in range(0, len(new), BATCH):
            part = new[at : at + BATCH]
            ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, "<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            whole, starts = ids.tobytes(), [0, *(4 * ends).tolist()]
            for word, a, b in zip(part, starts[:-1], starts[1:], strict=True):
                self.keep(word, whole[a:b])

    def ids(self, texts: list[str]) -> Iterator[bytes]:
        for at in range(0, len(texts), 500):
            split = [chunks_of(t) for t in texts[at : at + 500]]
            if long := self.learn(set().union(*split)):
                for chunks in split:
                    yield b"".join([long[c] if c in long else self[c] for c in chunks])
            else:
                for chunks in split:
                    yield b"".join(map(self.__getitem__, chunks))


def is_word(chunk: str) -> bool:
    """Letters alone, and still so when composed and lower-cased, as the vocabulary's normaliser does."""
    return chunk.isalpha() and (chunk.isascii() or unicodedata.normalize("NFC", chunk).lower().isalpha())


def lower(chunk: str) -> str:
    """Lower-cased where that cannot change the ids, so that fewer different chunks are encoded.

    The normaliser composes before it lower-cases, so other letters than ASCII's, and marks of special tokens, stay.
    """
    return chunk.lower() if chunk.isascii() and "<|" not in chunk else chunk


def chunks_of(text: str) -> list[str]:
    return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")


#: Marks that end many words; each is a token of its own after a letter.
TAILS = (",", ".")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, path: str, sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """One row for each piece: where it starts among its document's ids, its length and a checksum of its ids."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(columns, cache):
        out = {n: [] for n in ("doc_id", "piece", "start", "length", "ids_crc32")}
        for doc, ids in zip(columns["doc_id"].to_pylist(), cache.ids([t or "" for t in columns["text"].to_pylist()])):
            ids += end
            for piece, start in enumerate(range(0, len(ids) // 4, sequence)):
                part = ids[4 * start : 4 * (start + sequence)]
                for name, value in zip(out, (doc, piece, start, len(part) // 4, zlib.crc32(part))):
                    out[name].append(value)
        return out

    return map_rows(typed(docs, doc_id="long", text="string"), PIECES, cut, lambda: kept(WordCache, path))


def sum_of_squares(lengths: list[int] | np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence number, offset) for each length, none above size, placed in the given order.

    Counts are kept per gap. Using a gap of g for a length s changes the sum of squares by
    2·(n[g-s] - n[g]) + 2, a closed gap counting nothing; a new sequence is a gap of the full size of which
    none is counted. Ties go to the smaller gap.
    """
    count = np.zeros(size + 1, np.int64)
    open_at: list[list[int]] = [[] for _ in range(size + 1)]
    never = np.iinfo(np.int64).max
    where, offset, made = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i, s in enumerate(lengths):
        s = int(s)
        gaps = count[s:size]
        best, change = -1, never
        if len(gaps):
            cost = 2 * (count[: size - s] - gaps) + 2
            cost[0] -= 1 + 2 * count[0]  # a sequence that becomes full is no longer counted
            cost[gaps == 0] = never
            best = int(cost.argmin())
            change = int(cost[best])
        fresh = 2 * int(count[size - s]) + 1 if s < size else 0
        if change <= fresh and change != never:
            gap = best + s
            at = open_at[gap].pop()
            count[gap] -= 1
        else:
            gap, at, made = size, made, made + 1
        where[i], offset[i] = at, size - gap
        if gap > s:
            count[gap - s] += 1
            open_at[gap - s].append(at)
    return where, offset


def pack(cut: DataFrame, sequence: int = SEQUENCE, group: int = GROUP) -> DataFrame:
    """Adds sequence_id and offset to pieces. A full piece is a sequence of its own."""
    cut = settle(cut)
    groups = max(1, math.ceil(cut.count() / group))
    schema = f"{PIECES}, sequence_id long, offset long"

    def place(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        where, offset = sum_of_squares(rows["length"].to_numpy(), sequence)
        return rows.drop(columns="g").assign(sequence_id=where * groups + key[0], offset=offset)

    # with a number for each settled row: pieces that are equal in all columns spread over groups like any others
    dealt = cut.withColumn("g", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("g").applyInPandas(place, schema)


def best_fit_pack(docs: DataFrame, path: str | None = None, sequence: int = SEQUENCE, end_id: int = END_ID, group: int = GROUP) -> DataFrame:
    """Pack docs (doc_id, text; other columns are ignored) and return one row for each piece.

    Null and empty texts are the end id alone. Repeated rows are packed once each and spread over groups. Null doc_id
    stays null. Ties of length go by doc_id, piece and checksum. A text of any length is cut into pieces. An empty table gives no rows.
    """
    return pack(pieces(docs, path or tokenizer_path(), sequence, end_id), sequence, group)
