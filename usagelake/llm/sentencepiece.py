"""SentencePiece encoding and decoding over a relational lattice.

The piece table is the vocabulary file of a public tokenizer (its path is a parameter), one row for each
piece: id, piece, score. A text gets a dummy word start, spaces become word-start marks, and it is cut into units wherever
two neighbouring characters occur together in no piece, which no segmentation can cross. The lattice is
relational: the bounded-length substrings of the distinct units are exploded and equi-joined to the
piece table, the edges are grouped by unit, and the best path is folded with the higher-order
``aggregate``. Characters that are no piece fall back to their bytes. Of equal scores the longer last
piece wins.

Pieces that score less than their own best split are on no best path; they are left out of the table before everything
else, which leaves a third of a BPE vocabulary. A substring is exploded only where pieces begin like it; single characters, of which each has its edge, come with the unit.

Everything is one narrow pass: each task looks up the distinct units of its portion of documents, the (small, size-checked) piece
table is broadcast, and nothing is shuffled. So the edges of a unit stay in one task; they are grouped there by the unit's number, and a unit
whose edges aren't all together ends the job instead of giving wrong ids. A task holds the distinct units of one portion
(16 million characters, or one longer text) and the lattice of one batch of edges. A unit of many characters is exploded in
windows and folded in blocks, so its cost is in proportion to its length.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelake.llm.shared import freeing

#: The vocabulary used by the registered queries.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: A vocabulary is broadcast, so it may have no more pieces than this, and none longer than a byte can say.
MOST_PIECES = 1_000_000
LONGEST = 255
#: Characters of text whose distinct units are looked up together.
PORTION = 16 << 20
#: Documents that are put together at a time.
TOGETHER = 256
#: Characters of text that are cut into units together, and those of them that are looked at in one step.
CHUNK, STEP = 1 << 20, 1 << 18
#: Below every path of ordinary pieces: the cost of falling back to bytes.
FALLBACK = -1e9
#: Positions of a unit that are exploded in one row, and that are folded before their pieces are put aside.
WINDOW = 256
#: An edge as one number: (characters - 1) << 22, plus its piece's id or, for a fallback, 1 << 21 and the character's code point.
ID_BITS = 22
UNKNOWN = 1 << 21


class Vocabulary:
    """Pieces, scores, byte pieces, and which neighbouring characters occur together in a piece."""

    def __init__(self, model: bytes):
        import sentencepiece

        read = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = read.get_piece_size()
        if size > MOST_PIECES:
            raise ValueError(f"{size} pieces are too many to broadcast")
        self.pieces = [read.id_to_piece(i) for i in range(size)]
        self.plain = [i for i in range(size) if not (read.is_control(i) or read.is_unknown(i) or read.is_byte(i) or read.is_unused(i))]
        self.scores = [read.get_score(i) for i in range(size)]
        self.bytes = np.full(256, -1, dtype=np.int32)
        for i in range(size):
            if read.is_byte(i):
                self.bytes[int(self.pieces[i][3:5], 16)] = i
        if (self.bytes < 0).any():
            raise ValueError("the vocabulary has no byte pieces to fall back to")
        self.longest = max(len(self.pieces[i]) for i in self.plain)
        if self.longest > LONGEST:
            raise ValueError(f"a piece of {self.longest} characters is too long")
        self.useful = self._undominated()
        long = [self.pieces[i] for i in self.useful if len(self.pieces[i]) > 1]
        chars = sorted({c for p in long for c in p})
        self.known = np.zeros(0x110000, dtype=np.int32)  # 0: in no piece with others
        self.known[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        n = len(chars) + 1
        self.together = np.zeros((n, n), dtype=bool)
        self.two = np.zeros((n, n), dtype=bool)  # pieces of two characters
        self.pair = np.zeros((n, n), dtype=np.int32)  # numbers of the first two characters of longer pieces
        codes = [self.known[[ord(c) for c in p]] for p in long]
        for c in codes:
            self.together[c[:-1], c[1:]] = True
            if len(c) == 2:
                self.two[c[0], c[1]] = True
            elif not self.pair[c[0], c[1]]:
                self.pair[c[0], c[1]] = self.pair.max() + 1
        self.three = np.zeros((self.pair.max() + 1, n), dtype=np.uint8)  # the longest piece that begins with a pair and a third
        for c in codes:
            if len(c) > 2:
                at = self.pair[c[0], c[1]], c[2]
                self.three[at] = max(self.three[at], len(c))
        self.single = np.full(0x110000, -1, dtype=np.int32)
        for i in self.useful:
            if len(self.pieces[i]) == 1:
                self.single[ord(self.pieces[i])] = i
        mark = self.known[ord(MARK)]
        inner = self.together[:, mark].copy()
        inner[mark] = False
        self.across = bool(inner.any())  # a piece reaches from a word (a run of spaces and what follows) into the next
        self.text = [b""] * size  # what each id stands for; control pieces for nothing
        for i in self.plain:
            self.text[i] = self.pieces[i].replace(MARK, " ").encode()
        for b in range(256):
            self.text[self.bytes[b]] = bytes([b])

    def _undominated(self) -> list[int]:
        """The ordinary pieces that no sequence of shorter ones beats."""
        score = {self.pieces[i]: self.scores[i] for i in self.plain}
        out = []
        for i in self.plain:
            p = self.pieces[i]
            best = [0.0] + [-np.inf] * len(p)
            for end in range(1, len(p) + 1):
                best[end] = max(best[at] + score.get(p[at:end], -np.inf) if end - at < len(p) else -np.inf for at in range(end))
            if not best[-1] > self.scores[i] + 1e-6 * abs(self.scores[i]):
                out.append(i)
        return out

    def codes(self, text: str) -> np.ndarray:
        return self.known[points(text)]

    def substrings(self, code: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where pieces of two and more characters may stand: place and length; ``left``: characters from each place to its unit's end."""
        second, third = np.r_[code[1:], 0], np.r_[code[2:], 0, 0][: len(code)]
        most = np.where(left > 2, np.minimum(self.three[self.pair[code, second], third], left), 0).astype(np.int64)
        two = (self.two[code, second] & (left > 1)).astype(np.int64)
        count = two + np.maximum(most - 2, 0)
        total = np.cumsum(count)
        at = np.repeat(np.arange(len(code)), count)
        nth = np.arange(len(at)) - np.repeat(total - count, count)
        return at, nth + 3 - two[at]

    def units(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """The units of all texts one after the other, and how many each has: cut between words, and wherever no piece reaches across."""
        size = np.array([len(x) + 1 if x else 0 for x in texts])
        begin = (np.cumsum(size) - size)[size > 0]
        raw = "".join([" " + x for x in texts if x])
        s = raw.replace(" ", MARK)
        cuts, bytes_at, have, before, spaced = [], [], 0, 0, False
        for a in range(0, len(s), STEP):
            point = points(s[a : a + STEP])
            code = self.known[point]
            cut = np.empty(len(code), dtype=bool)
            cut[0] = not self.together[before, code[0]]
            cut[1:] = ~self.together[code[:-1], code[1:]]
            space = points(raw[a : a + STEP]) == ord(" ")
            if not self.across:
                cut |= space & ~np.r_[spaced, space[:-1]]
            cut[begin[np.searchsorted(begin, a) : np.searchsorted(begin, a + STEP)] - a] = True
            width = 1 + (point > 0x7F).astype(np.int64) + (point > 0x7FF) + (point > 0xFFFF)
            at = np.flatnonzero(cut)
            ends = np.cumsum(width)
            cuts.append(at + a)
            bytes_at.append(have + ends[at] - width[at])
            have, before, spaced = have + int(ends[-1]), code[-1], space[-1]
        cuts = np.concatenate([*cuts, [len(s)]])
        offsets = np.concatenate([*bytes_at, [have]])
        kind, wide = (pa.string(), np.int32) if have < 1 << 31 else (pa.large_string(), np.int64)
        units = pa.Array.from_buffers(kind, len(offsets) - 1, [None, pa.py_buffer(offsets.astype(wide)), pa.py_buffer(s.encode())])
        return units, np.diff(np.searchsorted(cuts, np.r_[0, np.cumsum(size)]))


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


@lru_cache(maxsize=2)
def _read(name: str) -> Vocabulary:
    with open(SparkFiles.get(name), "rb") as file:
        return Vocabulary(file.read())


def vocabulary(spark: SparkSession, model: str = MODEL) -> str:
    """Send the vocabulary file to all executors; returns its name there."""
    spark.sparkContext.addFile(model)
    return model.rsplit("/", 1)[-1]


def piece_table(spark: SparkSession, model: str = MODEL) -> DataFrame:
    """One row for each ordinary piece that can be on a best path: id, piece, score."""
    v = _read(vocabulary(spark, model))
    return spark.createDataFrame([(i, v.pieces[i], float(v.scores[i])) for i in v.useful], "id int, piece string, score double")


#: Rows of one table: documents (doc_id, doc: numbers of units, as 32-bit integers) and windows of units (number, place of
#: the window in the unit, its text, its substrings as place * 256 + length).
_ROWS = ["doc_id", "doc", "number", "place", "word", "codes"]


def _portions(name: str):
    """For each portion of documents its distinct units, then its documents as numbers of units."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _read(name)
        ids, units, sizes, texts, have, new = [], [], [], [], 0, 0
        for batch in batches:
            ids.append(batch.column("doc_id"))
            for text in batch.column("text"):
                texts.append(text.as_py())
                new += len(texts[-1] or "")
                if new >= CHUNK:
                    _cut(v, texts, units, sizes)
                    texts, have, new = [], have + new, 0
            if have + new >= PORTION:
                _cut(v, texts, units, sizes)
                yield from _portion(v, ids, units, sizes)
                ids, units, sizes, texts, have, new = [], [], [], [], 0, 0
        if ids:
            _cut(v, texts, units, sizes)
            yield from _portion(v, ids, units, sizes)

    return run


def _cut(v: Vocabulary, texts: list[str], units: list[pa.Array], sizes: list[np.ndarray]) -> None:
    """Add the units of some texts, distinct ones and which of them come one after the other, and how many each text has."""
    found, n = v.units(texts)
    units.append(found.dictionary_encode())
    sizes.append(n)


def _lists(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)], pa.int32()), pa.array(values, pa.int32()))


def _portion(v: Vocabulary, ids: list[pa.Array], found: list[pa.Array], sizes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    doc_ids = pa.concat_arrays(ids)
    together = pa.chunked_array([x.cast(pa.dictionary(pa.int32(), pa.large_string())) for x in found]).unify_dictionaries()
    found.clear()
    units = together.chunk(together.num_chunks - 1).dictionary
    length = pc.utf8_length(units).to_numpy(zero_copy_only=False)
    part = np.cumsum(length) // (1 << 17)
    bounds = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(units)] if len(units) else [0]
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        yield from _windows(v, units.slice(a, b - a), length[a:b], a, doc_ids.type)
    at = 0
    for numbers, many in zip(together.chunks, sizes, strict=True):
        numbers, ends = numbers.indices.to_numpy(), np.r_[0, np.cumsum(many)]
        for a in range(0, len(many), 1000):
            n = min(1000, len(many) - a)
            some = numbers[ends[a] : ends[a + n]]
            docs = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(((ends[a : a + n + 1] - ends[a]) * 4).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(some))])
            empty = pa.nulls(n, pa.int32())
            yield pa.RecordBatch.from_arrays([doc_ids.slice(at, n), docs, empty, empty, pa.nulls(n, pa.string()), pa.nulls(n, pa.list_(pa.int32()))], names=_ROWS)
            at += n


def _windows(v: Vocabulary, units: pa.Array, size: np.ndarray, number: int, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """The windows of some units: those of their substrings that may be pieces, each with the text that they need; a unit's first window begins with 0 and has its whole text."""
    ends = np.cumsum(size, dtype=np.int64)
    left = np.repeat(ends, size) - np.arange(ends[-1])
    at, n = v.substrings(v.codes("".join(units.to_pylist())), left)
    place = np.repeat(size, size) - left  # of each character in its unit
    blocks = -(-size // WINDOW)
    owner = np.repeat(np.arange(len(units)), blocks)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    window = (np.cumsum(blocks) - blocks)[np.repeat(np.arange(len(units)), size)[at]] + place[at] // WINDOW
    code = (place[at] % WINDOW << 8) + n
    first = np.flatnonzero(nth == 0)
    lengths = np.bincount(window, minlength=len(owner))
    code = np.insert(code, (np.cumsum(lengths) - lengths)[first], 0)
    lengths[first] += 1
    if len(owner) == len(units):
        texts = units.cast(pa.string())
    else:
        whole = units.to_pylist()
        texts = pa.array([whole[u] if not k else whole[u][k * WINDOW : (k + 1) * WINDOW + v.longest] for u, k in zip(owner.tolist(), nth.tolist(), strict=True)], pa.string())
    none = len(owner)
    yield pa.RecordBatch.from_arrays(
        [pa.nulls(none, kind), pa.nulls(none, pa.binary()), pa.array((owner + number).astype(np.int32)),
         pa.array((nth * WINDOW).astype(np.int32)), texts, _lists(code, lengths)], names=_ROWS)


_EDGE = pa.struct([("code", pa.int32()), ("score", pa.float64())])


def _heads(batch: pa.RecordBatch) -> np.ndarray:
    """The rows that begin a document or a unit."""
    return np.flatnonzero(batch.column("spot").fill_null(0).to_numpy(zero_copy_only=False) == 0)


def _unit_rows(batch: pa.RecordBatch, v: Vocabulary, scores: np.ndarray) -> pa.RecordBatch:
    """Edge rows of whole units and document rows as one row each: for each position of the unit the list of edges that end there, in blocks."""
    head = _heads(batch)
    some = batch.take(pa.array(head))
    edge = np.ones(batch.num_rows, dtype=bool)
    edge[head] = False
    edge = np.flatnonzero(edge)
    row = np.searchsorted(head, edge, side="right") - 1
    number, spot, piece = (batch.column(c).take(pa.array(edge)).to_numpy(zero_copy_only=False) for c in ("number", "spot", "piece_id"))
    if (number != some.column("number").fill_null(-1).to_numpy(zero_copy_only=False)[row]).any():
        raise RuntimeError("the edges of a unit came apart")
    units = ["" if u is None else u for u in some.column("unit").to_pylist()]
    size = np.array([len(u) for u in units])
    base = np.cumsum(size) - size
    point = points("".join(units)).astype(np.int64)
    alone = v.single[point].astype(np.int64)
    piece = np.r_[np.where(alone < 0, UNKNOWN + point, alone), piece]
    n = np.r_[np.ones(len(point), np.int64), spot & 255]
    place = np.r_[np.arange(len(point)), base[row] + (spot >> 8) + (spot & 255) - 1]
    order = np.argsort(place, kind="stable")
    piece, n = piece[order], n[order]
    code = (n - 1 << ID_BITS) + piece
    score = np.where(piece < UNKNOWN, scores[np.minimum(piece, len(scores) - 1)], FALLBACK)
    edges = pa.StructArray.from_arrays([pa.array(code.astype(np.int32)), pa.array(score)], fields=list(_EDGE))
    inner = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(place, minlength=len(point)))], pa.int32()), edges)
    blocks = -(-size // WINDOW)
    owner = np.repeat(np.arange(len(size)), blocks)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    middle = pa.ListArray.from_arrays(pa.array(np.r_[base[owner] + nth * WINDOW, size.sum()], pa.int32()), inner)
    outer = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(blocks)], pa.int32()), middle)
    return pa.RecordBatch.from_arrays([some.column(c) for c in ("doc_id", "doc", "number")] + [outer], names=["doc_id", "doc", "number", "ends"])


def _grouped(name: str):
    """The edges of each unit become one row; documents pass."""

    def whole(parts: list[pa.RecordBatch], v: Vocabulary, scores: np.ndarray) -> Iterator[pa.RecordBatch]:
        if sum(b.num_rows for b in parts):
            yield _unit_rows(pa.Table.from_batches(parts).combine_chunks().to_batches()[0], v, scores)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _read(name)
        scores = np.array(v.scores, np.float64)
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            head = _heads(batch)
            if len(head):
                last = int(head[-1])
                yield from whole([*rest, batch.slice(0, last)], v, scores)
                rest = [batch.slice(last)]
            else:
                rest.append(batch)
        yield from whole(rest, v, scores)

    return run


def last_pieces(ends: Column, longest: int) -> Column:
    """Viterbi over ``ends``, for each position (in blocks) its edges (code, score): each position's last piece on its best path, from the unit's end.

    The fold carries the best score and the last piece of the positions so far, newest first; after each block only those of the
    last ``longest`` positions go on and the pieces are put aside. Following the pieces from the first gives the best path.
    """
    best = "array<struct<s:double,code:int>>"
    states = f"struct<win:{best},back:array<array<int>>>"

    def position(acc: Column, edges: Column) -> Column:
        paths = F.transform(edges, lambda e: F.struct((F.get(acc, F.shiftright(e["code"], ID_BITS))["s"] + e["score"]).alias("s"), e["code"].alias("code")))
        return F.array_prepend(acc, F.array_max(paths))

    def block(acc: Column, positions: Column) -> Column:
        new = F.array(F.aggregate(positions, acc["win"], position))
        return F.get(F.transform(new, lambda x: F.struct(F.slice(x, 1, longest).alias("win"), F.concat(
            F.array(F.transform(F.slice(x, 1, F.size(positions)), lambda y: y["code"])), acc["back"]).alias("back")).cast(states)), F.lit(0))

    origin = F.array(F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("code"))).cast(best)
    blocks = F.aggregate(ends, F.struct(origin.alias("win"), F.array().cast("array<array<int>>").alias("back")).cast(states), block, lambda acc: F.flatten(acc["back"]))
    one = F.aggregate(F.get(ends, F.lit(0)), origin, position, lambda acc: F.slice(acc, F.lit(1), F.size(acc) - 1)["code"])
    return F.when(F.size(ends) == 1, one).otherwise(blocks)  # nearly all units are one block


def _assembled(name: str, decoded: bool):
    """Documents as ids, from the paths of the units that precede them; also as the text that these decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _read(name)
        flat: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        ready = None
        for batch in batches:
            is_unit = batch.column("number").is_valid().to_numpy(zero_copy_only=False)
            edge = np.flatnonzero(np.diff(np.r_[-1, is_unit.astype(np.int8), -1])).tolist()
            runs = list(zip(edge[:-1], edge[1:], strict=True))
            for a, b in [(i, min(b, i + step)) for a, b in runs for step in [b - a if is_unit[a] else TOGETHER] for i in range(a, b, step)]:
                part = batch.slice(a, b - a)
                if is_unit[a]:
                    if ready is not None:
                        flat, sizes, ready = [], [], None
                    if part.column("number")[0].as_py() != sum(map(len, sizes)):
                        raise RuntimeError("the units of a portion came apart")
                    ids, n = _forward(v, part.column("lasts"))
                    flat.append(ids)
                    sizes.append(n)
                    continue
                if ready is None:
                    n = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
                    ready = (np.concatenate(flat) if flat else np.zeros(0, np.int32), np.cumsum(n) - n, n)
                ids, begin, n = ready
                doc = part.column("doc").to_pylist()
                units = np.frombuffer(b"".join(doc), np.int32)
                many, each = n[units], np.array([len(x) // 4 for x in doc])
                ends = np.cumsum(many)
                at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - many - begin[units], many)
                bounds = np.r_[0, ends][np.r_[0, np.cumsum(each)]]
                out = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids[at], pa.int32()))
                columns, names = [part.column("doc_id"), out], ["doc_id", "ids"]
                if decoded:
                    each = [ids[at[a:b]].tolist() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                    columns.append(pa.array([_text(v, x) for x in each], pa.string()))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _forward(v: Vocabulary, lasts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all units, one after the other, and their numbers: last pieces followed from the end, characters without piece as bytes."""
    size = lasts.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    codes = lasts.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(size)
    on = np.zeros(len(codes), dtype=bool)
    at, stop = ends - size, ends
    while len(at):
        on[at] = True
        at = at + (codes[at] >> ID_BITS) + 1
        at, stop = at[at < stop], stop[at < stop]
    owner = np.repeat(np.arange(len(size)), size)[on][::-1]
    ids = codes[on][::-1] & (1 << ID_BITS) - 1
    order = np.argsort(owner, kind="stable")
    ids, n = ids[order], np.bincount(owner, minlength=len(size))
    odd = np.flatnonzero(ids >= UNKNOWN)
    if not len(odd):
        return ids, n
    spelt = [v.bytes[list(chr(c - UNKNOWN).encode("utf-8", "surrogatepass"))] for c in ids[odd].tolist()]
    extra = np.array([len(x) - 1 for x in spelt])
    begin = odd + np.cumsum(extra) - extra
    n = n + np.bincount(np.searchsorted(np.cumsum(n), odd, side="right"), extra, len(n)).astype(np.int64)
    ids = np.repeat(ids, 1 + np.bincount(odd, extra, len(ids)).astype(np.int64))
    ids[np.repeat(begin - np.r_[0, np.cumsum(extra + 1)[:-1]], extra + 1) + np.arange((extra + 1).sum())] = np.concatenate(spelt)
    return ids, n


def _text(v: Vocabulary, ids: list[int]) -> str:
    """What ids stand for, without the space of the dummy word start."""
    return b"".join(map(v.text.__getitem__, ids))[1:].decode("utf-8", "replace")


def encode(docs: DataFrame, model: str = MODEL, decoded: bool = False) -> DataFrame:
    """One row for each row of ``docs(doc_id, text)``: doc_id and ``ids``, the best-scoring segmentation; ``decoded``: also what they decode to.

    White space is kept (a space is a word-start mark, everything else that is no piece falls back to bytes), so
    ``decode`` restores each text exactly, except that a mark U+2581 in a text decodes as a space. Null
    and empty texts have no ids; an empty table gives no rows; repeated rows and null ids of
    documents are returned as they are; other columns are ignored. Very long texts, also without any space, are encoded whole.
    """
    spark = docs.sparkSession
    name = vocabulary(spark, model)
    longest = _read(name).longest
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").mapInArrow(freeing(_portions(name)), f"doc_id {kind}, doc binary, number int, place int, word string, codes array<int>")
    start, n = F.shiftright("code", 8), F.col("code").bitwiseAND(255)
    edges = rows.select("doc_id", "doc", "number", "place", "word", F.explode_outer("codes").alias("code")).select(
        "doc_id", "doc", "number", ((F.col("place") + start).cast("long") * 256 + n).alias("spot"), F.substring("word", start + 1, n).alias("piece"),
        F.when(F.col("code") == 0, F.col("word")).alias("unit"))
    edges = edges.join(F.broadcast(piece_table(spark, model)), "piece", "left").filter("number is null or unit is not null or id is not null")
    edges = edges.select("doc_id", "doc", "number", "spot", F.col("id").alias("piece_id"), "unit")
    units = edges.mapInArrow(freeing(_grouped(name)), f"doc_id {kind}, doc binary, number int, ends array<array<array<struct<code:int,score:double>>>>")
    # Lists that are null for many rows on end are slow to send to Python, so a document's is empty.
    lasts = F.when(F.col("number").isNotNull(), last_pieces(F.col("ends"), longest)).otherwise(F.array().cast("array<int>"))
    return units.select("doc_id", "doc", "number", lasts.alias("lasts")).mapInArrow(freeing(_assembled(name, decoded)), f"doc_id {kind}, ids array<int>" + ", decoded string" * decoded)


def _decoded(name: str, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _read(name)
        for batch in batches:
            ids = batch.column("ids").to_pylist()
            made = [None if x is None else _text(v, x) for x in ids]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], names=[*columns, "decoded"])

    return run


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """``encoded`` with the text of its ``ids`` in a column ``decoded``: null for null, empty for no ids."""
    name = vocabulary(encoded.sparkSession, model)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(_decoded(name, encoded.columns), f"{schema}, decoded string")


def digest(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """Each document's ids, their number, and the digest of the text that they decode to."""
    return encode(docs, model, decoded=True).select(
        "doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
