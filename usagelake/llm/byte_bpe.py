"""Byte-level BPE encoding and decoding on length-bucketed padded matrices.

A task takes its texts in portions of some megabytes, cuts them by the pattern and works out each distinct piece of a portion
once. A piece that is itself a token is that token. The others stand as rows of byte tokens in matrices, one for each range
of lengths, padded at the right. Each round looks for every row's leftmost pair of the smallest rank, merges it, closes the
gap, and looks up the two pairs that the merge has made in a hash table of all pairs of tokens whose bytes together are a
token; rows without such a pair leave the matrix, which is a column narrower after each round. Rows of more than ``LONG``
bytes stand alone and merge all their pairs of the smallest rank in one round, up to the first merge that makes a pair of a rank as
small, which is what merging them one by one does, so a megabyte of one sign takes some twenty rounds.

Nothing is shuffled and nothing is trained; the rank file goes to the tasks once, as bytes whose size the vocabulary bounds.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelake.llm.shared import freeing

#: Stands for no token and no rank.
NONE = np.uint32(0xFFFFFFFF)
#: The largest lengths, in bytes, of the matrices' rows; longer rows stand alone.
WIDTHS = (2, 3, 4, 5, 6, 8, 10, 12, 16, 24, 32, 64, 128)
LONG = WIDTHS[-1]
#: Most cells of a matrix, and bytes of a portion of texts.
CELLS = 1 << 20
PORTION = 4 << 20

_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_FREE = np.uint64(0xFFFFFFFFFFFFFFFF)


def rank_file() -> str:
    """The place of the public vocabulary of some 50,000 tokens."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class Vocabulary:
    """A rank file's tokens, and its pairs in a hash table with open addressing."""

    def __init__(self, data: bytes):
        self.ids = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line.strip())}
        self.tokens = {rank: token for token, rank in self.ids.items()}
        self.bytes = np.full(256, NONE, dtype=np.uint32)
        for value in range(256):
            self.bytes[value] = self.ids.get(bytes([value]), NONE)
        if (self.bytes == NONE).any():
            raise ValueError("the rank file must hold all 256 single bytes")
        pairs = [(self.ids[token[:i]], self.ids[token[i:]], rank) for token, rank in self.ids.items() for i in range(1, len(token))
                 if token[:i] in self.ids and token[i:] in self.ids]
        table = np.array(pairs, dtype=np.uint64).reshape(-1, 3)
        self._fill((table[:, 0] << np.uint64(32)) | table[:, 1], table[:, 2].astype(np.uint32))

    def _fill(self, keys: np.ndarray, ranks: np.ndarray) -> None:
        bits = max(4, int(4 * len(keys)).bit_length())
        self._shift, self._mask = np.uint64(64 - bits), (1 << bits) - 1
        self._keys, self._ranks = np.full(1 << bits, _FREE), np.full(1 << bits, NONE)
        todo, slot = np.arange(len(keys)), ((keys * _SPREAD) >> self._shift).astype(np.int64)
        while len(todo):
            free = np.flatnonzero(self._keys[slot] == _FREE)
            _, first = np.unique(slot[free], return_index=True)
            placed = free[first]
            self._keys[slot[placed]], self._ranks[slot[placed]] = keys[todo[placed]], ranks[todo[placed]]
            rest = np.ones(len(todo), dtype=bool)
            rest[placed] = False
            todo, slot = todo[rest], (slot[rest] + 1) & self._mask

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank (the merged token) of each pair, ``NONE`` where the two together are no token."""
        keys = ((left.astype(np.uint64) << np.uint64(32)) | right).ravel()
        slot = ((keys * _SPREAD) >> self._shift).astype(np.int64)
        found = self._keys[slot]
        out = np.where(found == keys, self._ranks[slot], NONE)
        todo = np.flatnonzero((found != keys) & (found != _FREE))
        slot = slot[todo]
        while len(todo):
            slot = (slot + 1) & self._mask
            found = self._keys[slot]
            hit = found == keys[todo]
            out[todo[hit]] = self._ranks[slot[hit]]
            more = ~hit & (found != _FREE)
            todo, slot = todo[more], slot[more]
        return out.reshape(left.shape)


def merge_rows(rows: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    """All merges of a padded matrix of byte tokens, its leftmost pair of the smallest rank first in each row."""
    out = np.full_like(rows, NONE)
    place, width = np.arange(len(rows)), rows.shape[1]
    ranks = vocabulary.pair_ranks(rows[:, :-1], rows[:, 1:])
    while width > 1 and len(rows):
        at = ranks.argmin(axis=1)
        low = ranks[np.arange(len(rows)), at]
        going = low != NONE
        if not going.all():
            out[place[~going], :width] = rows[~going]
            rows, ranks, place, at, low = rows[going], ranks[going], place[going], at[going], low[going]
            if not len(rows):
                return out
        n = np.arange(len(rows))
        rows[n, at] = low
        width -= 1
        columns, gap = np.arange(width), at[:, None]
        rows = np.take_along_axis(rows, columns + (columns > gap), axis=1)
        if width == 1:
            break
        columns = columns[:-1]
        ranks = np.take_along_axis(ranks, columns + (columns >= gap), axis=1)
        left, right = np.flatnonzero(at > 0), np.flatnonzero(at < width - 1)
        ranks[left, at[left] - 1] = vocabulary.pair_ranks(rows[left, at[left] - 1], rows[left, at[left]])
        ranks[right, at[right]] = vocabulary.pair_ranks(rows[right, at[right]], rows[right, at[right] + 1])
    out[place, :width] = rows
    return out


def merge_long(row: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    """``merge_rows`` for one long row: in a round all pairs of the smallest rank, from the left up to one that makes a pair of a rank as small."""
    ranks = vocabulary.pair_ranks(row[:-1], row[1:])
    while len(ranks):
        low = ranks.min()
        if low == NONE:
            break
        at = np.flatnonzero(ranks == low)
        # Of pairs that share a token, from the left every other one.
        head = np.flatnonzero(np.r_[True, np.diff(at) != 1])
        at = at[(np.arange(len(at)) - np.repeat(head, np.diff(np.r_[head, len(at)]))) % 2 == 0]

        def merged(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """The row and its pairs after these merges, and which of them have made a pair of a rank as small."""
            new = row.copy()
            new[at] = low
            stay = np.ones(len(row), dtype=bool)
            stay[at + 1] = False
            spot = (np.cumsum(stay) - 1)[at]
            new = new[stay]
            pairs = np.delete(ranks, at)
            left, right = spot[spot > 0], spot[spot < len(new) - 1]
            pairs[left - 1] = vocabulary.pair_ranks(new[left - 1], new[left])
            pairs[right] = vocabulary.pair_ranks(new[right], new[right + 1])
            # Each merge meets the token before it as merges from the left have left it, and the one behind as it was.
            odd = np.zeros(len(at), dtype=bool)
            odd[spot > 0] = pairs[left - 1] <= low
            behind = at + 2 < len(row)
            odd[behind] |= vocabulary.pair_ranks(np.full(int(behind.sum()), low, dtype=np.uint32), row[at[behind] + 2]) <= low
            return new, pairs, odd

        new, pairs, odd = merged(at)
        if odd[:-1].any():  # the pair that the first of these makes is next
            new, pairs, _ = merged(at[: int(odd.argmax()) + 1])
        row, ranks = new, pairs
    return row


def encode_pieces(pieces: list[bytes], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of all pieces, one after the other, and each piece's number of tokens."""
    whole = np.array([vocabulary.ids.get(p, -1) for p in pieces], dtype=np.int64)
    counts = np.ones(len(pieces), dtype=np.int64)
    parts: list[tuple[np.ndarray, np.ndarray]] = []  # numbers of pieces, and their tokens one after the other
    known = np.flatnonzero(whole >= 0)
    parts.append((known, whole[known].astype(np.uint32)))
    rest = np.flatnonzero(whole < 0)
    lengths = np.array([len(pieces[i]) for i in rest.tolist()], dtype=np.int64)
    low = 0
    for width in WIDTHS:
        bucket = rest[(lengths > low) & (lengths <= width)]
        low = width
        for some in np.array_split(bucket, max(1, -(-len(bucket) * width // CELLS))):
            if not len(some):
                continue
            n = np.array([len(pieces[i]) for i in some.tolist()])
            rows = np.full((len(some), width), NONE)
            rows[np.arange(width) < n[:, None]] = vocabulary.bytes[np.frombuffer(b"".join([pieces[i] for i in some.tolist()]), dtype=np.uint8)]
            rows = merge_rows(rows, vocabulary)
            inside = rows != NONE
            counts[some] = inside.sum(axis=1)
            parts.append((some, rows[inside]))
    for i in rest[lengths > LONG].tolist():
        row = merge_long(vocabulary.bytes[np.frombuffer(pieces[i], dtype=np.uint8)], vocabulary)
        counts[i] = len(row)
        parts.append((np.array([i]), row))
    starts = np.cumsum(counts) - counts
    flat = np.empty(int(counts.sum()), dtype=np.uint32)
    for some, tokens in parts:
        flat[_spread(starts[some], counts[some])] = tokens
    return flat, counts


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1 ... for each start, count of them."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))


def encode_texts(texts: list[str], vocabulary: Vocabulary, pattern: regex.Pattern) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of all texts, one after the other, and where each text's begin (one more at the end)."""
    index: dict[str, int] = {}
    number = index.setdefault
    at, ends = [], [0]
    for text in texts:
        at.extend([number(p, len(index)) for p in pattern.findall(text)])
        ends.append(len(at))
    flat, counts = encode_pieces([p.encode() for p in index], vocabulary)
    at = np.array(at, dtype=np.int64)
    each = counts[at]
    offsets = np.concatenate([[0], np.cumsum(each)])[ends]
    return flat[_spread((np.cumsum(counts) - counts)[at], each)], offsets


def decode_ids(ids: list[int], vocabulary: Vocabulary) -> bytes:
    token = vocabulary.tokens.get
    return b"".join([token(i, b"") for i in ids])


_kept: dict[bytes, Vocabulary] = {}


def _vocabulary(data: bytes) -> Vocabulary:
    """The file's vocabulary, built once in a worker."""
    key = hashlib.sha256(data).digest()
    if key not in _kept:
        _kept.clear()
        _kept[key] = Vocabulary(data)
    return _kept[key]


def _read(df: DataFrame, vocabulary: str | None) -> bytes:
    with open(vocabulary or rank_file(), "rb") as file:
        return file.read()


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    """First columns and texts, some ``PORTION`` bytes of text at a time."""
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        start, held, have = 0, [], 0
        for i in range(batch.num_rows):
            text = texts[i].as_py() or ""
            held.append(text)
            have += len(text)
            if have >= PORTION or i == batch.num_rows - 1:
                yield ids.slice(start, i + 1 - start), held
                start, held, have = i + 1, [], 0


def _task(data, pattern: str, columns: Callable) -> Callable:
    """A task's function over (doc_id, text): ``columns(flat, offsets, vocabulary)`` gives what follows doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, split = _vocabulary(data.value), regex.compile(pattern)
        for ids, texts in _portions(batches):
            flat, offsets = encode_texts(texts, vocabulary, split)
            more = columns(flat, offsets, vocabulary)
            yield pa.RecordBatch.from_arrays([ids, *more.values()], names=["doc_id", *more])

    return freeing(run)


def _kind(docs: DataFrame) -> str:
    return docs.select("doc_id").schema["doc_id"].dataType.simpleString()


def encode(docs: DataFrame, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """One row ``doc_id, ids array<int>`` for each row of ``docs(doc_id, text)``.

    ``vocabulary`` is the path of a rank file (a line for each token: base64, rank), read by the driver. Null and empty texts have no
    ids; repeated rows and ids stay; other columns are ignored, whatever their names; an empty table gives no rows. Texts of any
    length are encoded whole: memory grows with one text and a portion. A piece of n bytes takes a round for each rank that it merges.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_read(docs, vocabulary))

    def columns(flat, offsets, _):
        return {"ids": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat.view(np.int32)))}

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        _task(shared, pattern or split_pattern(), columns), f"doc_id {_kind(docs)}, ids array<int>")


def decode(tokens: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """One row ``doc_id, data binary`` for each row of ``tokens(doc_id, ids)``: the bytes of the ids.

    Ids that are null or not in the file stand for no bytes, as do null lists. Bytes needn't be valid UTF-8, as ids may come from anywhere.
    """
    shared = tokens.sparkSession.sparkContext.broadcast(_read(tokens, vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _vocabulary(shared.value)
        for batch in batches:
            data = [decode_ids(ids.as_py() or [], known) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=["doc_id", "data"])

    return tokens.select("doc_id", F.col("ids").cast("array<int>").alias("ids")).mapInArrow(freeing(run), f"doc_id {_kind(tokens)}, data binary")


def digest(docs: DataFrame, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """``encode`` and ``decode`` in one task: doc_id, n_tokens, and digests of the ids (little-endian, 32 bits each) and of the decoded bytes."""
    shared = docs.sparkSession.sparkContext.broadcast(_read(docs, vocabulary))

    def columns(flat, offsets, known):
        small = flat.astype("<u4")
        spans = list(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True))
        return {
            "n_tokens": pa.array(np.diff(offsets), pa.int64()),
            "ids_sha256": pa.array([hashlib.sha256(small[a:b].tobytes()).hexdigest() for a, b in spans], pa.string()),
            "decoded_sha256": pa.array([hashlib.sha256(decode_ids(flat[a:b].tolist(), known)).hexdigest() for a, b in spans], pa.string()),
        }

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        _task(shared, pattern or split_pattern(), columns), f"doc_id {_kind(docs)}, n_tokens long, ids_sha256 string, decoded_sha256 string")
