"""SentencePiece encoding and decoding by a streaming Viterbi search (operator 3).

The lattice of a text has an edge for every piece of the vocabulary. Only the last `longest` positions can still be the
start of an edge; once the backpointer paths of all of these pass one boundary, the ids before it are final and leave the
window. In a unigram model the best sum of scores decides between the edges that end at a position. In a BPE model
exactly one does: a sequence of pieces is what merging gives if, and only if, each piece and each pair of neighbours is
what merging gives for its own text, so that the path through pairs of that kind is the only one.

Where no piece crosses from another character to a space, all paths pass every start of a word; words are then final one
by one, and the ids of recent words are kept.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.llm.shared import columns, text_or_empty, unused, without

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Two generations of recent words, so many each.
KEPT_WORDS = 250_000
KEPT_PAIRS = 1_000_000
SLICE_BYTES = 1 << 21
#: What stands before the first piece.
NOTHING = -(1 << 21)


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message."""

    def varint(i: int) -> tuple[int, int]:
        out = shift = 0
        while True:
            out |= (data[i] & 127) << shift
            if data[i] < 128:
                return out, i + 1
            i, shift = i + 1, shift + 7

    i = 0
    while i < len(data):
        tag, i = varint(i)
        kind = tag & 7
        if kind == 0:
            value, i = varint(i)
        elif kind == 2:
            n, i = varint(i)
            value, i = data[i : i + n], i + n
        else:
            n = 8 if kind == 1 else 4
            value, i = data[i : i + n], i + n
        yield tag >> 3, value


class Vocabulary:
    """Pieces, scores and settings of a model file, given as bytes."""

    def __init__(self, model: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.types: list[int] = []
        self.model_type, self.byte_fallback, self.prefix, self.collapse, charsmap = UNIGRAM, False, True, True, b""
        for number, value in _fields(model):
            if number == 1:
                own = dict(_fields(value))
                self.pieces.append(own.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                self.types.append(own.get(3, NORMAL))
            elif number == 2:
                own = dict(_fields(value))
                self.model_type, self.byte_fallback = own.get(3, UNIGRAM), bool(own.get(35, 0))
            elif number == 3:
                own = dict(_fields(value))
                charsmap, self.prefix, self.collapse = own.get(2, b""), bool(own.get(3, 1)), bool(own.get(4, 1))
        if charsmap or self.model_type not in (UNIGRAM, BPE) or USER in self.types or UNUSED in self.types:
            raise ValueError("only unigram and BPE models without a normalisation table, user-defined or unused pieces are supported")
        self.ids = {p: i for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t == NORMAL}
        self.unknown = self.types.index(UNKNOWN)
        self.bytes = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t == BYTE}
        self.longest = max(map(len, self.ids), default=1)
        self.tree: dict = {}
        for p, i in self.ids.items():
            node = self.tree
            for c in p:
                node = node.setdefault(c, {})
            node[""] = i
        self.near = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.by_word = self.byte_fallback and not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        #: An unknown character scores less than any piece.
        self.penalty = min((self.scores[i] for i in self.ids.values()), default=0.0) - 10.0
        self.bytes_of = pa.array([self._bytes(i) for i in range(len(self.pieces))], pa.large_binary())

    def _bytes(self, i: int) -> bytes:
        if self.types[i] == BYTE:
            return bytes([int(self.pieces[i][3:5], 16)])
        return b"" if self.types[i] == CONTROL else " ⁇ ".encode() if self.types[i] == UNKNOWN else self.pieces[i].replace(SPACE, " ").encode()

    def normal(self, text: str) -> str:
        if self.collapse:
            text = re.sub(" +", " ", text.strip(" "))
        return (SPACE if self.prefix and text else "") + text.replace(" ", SPACE)

    def merged(self, text: str) -> list[str]:
        """The symbols that merging the best pair, the leftmost on ties, gives for a short text."""
        symbols = list(text)
        while len(symbols) > 1:
            found = [(-self.scores[self.ids[p]], i) for i in range(len(symbols) - 1) if (p := symbols[i] + symbols[i + 1]) in self.ids]
            if not found:
                break
            i = min(found)[1]
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
        return symbols


class Encoder:
    """encode() and decode() of one process; keeps a bounded number of words and of pairs of pieces."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.words: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[int, bool] = {}
        self.split = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+") if vocabulary.by_word else None

    def text_of(self, piece: int) -> str:
        """The text of a piece, or of a character outside the vocabulary, which stands as its complement."""
        return self.v.pieces[piece] if piece >= 0 else "" if piece == NOTHING else chr(~piece)

    def fits(self, left: int, right: int) -> bool:
        """Whether merging leaves left and right as neighbours."""
        if len(self.pairs) >= KEPT_PAIRS:
            self.pairs.clear()
        one, two = self.text_of(left), self.text_of(right)
        found = self.pairs[(left << 22) + right] = self.v.merged(one + two) == ([one, two] if one else [two])
        return found

    def stream(self, text: str) -> Iterator[list[int]]:
        """The pieces of a normalised text, in lists, each as soon as all paths that live on pass its end."""
        tree, longest, bpe, pairs, fits = self.v.tree, self.v.longest, self.v.model_type == BPE, self.pairs, self.fits
        scores, penalty, n = self.v.scores, self.v.penalty, len(text)
        back: dict[int, tuple[int, float, int]] = {0: (-1, 0.0, NOTHING)}  # position: start, sum and number of the last piece
        done = 0
        for i in range(n):
            here = back.get(i)
            if here is not None:
                _, score, left = here
                node, j = tree.get(text[i]), i + 1
                if node is None or "" not in node:
                    other = ~ord(text[i])
                    if not bpe:
                        if j not in back or score + penalty > back[j][1]:
                            back[j] = (i, score + penalty, other)
                    elif j not in back and (pairs.get((left << 22) + other) or fits(left, other)):
                        back[j] = (i, 0.0, other)
                while node is not None:
                    piece = node.get("")
                    if piece is not None:
                        if bpe:
                            if j not in back:
                                ok = pairs.get((left << 22) + piece)
                                if ok or ok is None and fits(left, piece):
                                    back[j] = (i, 0.0, piece)
                        else:
                            total = score + scores[piece]
                            if j not in back or total > back[j][1]:
                                back[j] = (i, total, piece)
                    if j == n:
                        break
                    node = node.get(text[j])
                    j += 1
            if (i + 1) % longest == 0 or i + 1 == n:
                paths = {n} if i + 1 == n else {p for p in back if p > i}
                while len(paths) > 1:  # the farthest steps back until all have met
                    far = max(paths)
                    paths.discard(far)
                    paths.add(max(back[far][0], done))
                end = paths.pop() if paths else done
                if end > done:
                    out, at = [], end
                    while at > done:
                        out.append(back[at][2])
                        at = back[at][0]
                    yield out[::-1]
                    if end < n:
                        back = {p: x for p, x in back.items() if p > end} | {end: (-1, back[end][1], back[end][2])}
                    done = end

    def ids_of(self, text: str) -> tuple[int, ...]:
        v, out = self.v, []
        for pieces in self.stream(text):
            for p in pieces:
                if p >= 0:
                    out.append(p)
                elif v.byte_fallback:
                    out.extend(v.bytes[b] for b in chr(~p).encode("utf-8"))
                elif not out or out[-1] != v.unknown:
                    out.append(v.unknown)
        return tuple(out)

    def encode(self, texts: pa.Array) -> pa.Array:
        """The ids of each text (a string array without nulls), as lists.

        Where texts part into words, each distinct word of the batch is looked up once; the rest is done for whole arrays."""
        if self.split is None:
            ids = [self.ids_of(self.v.normal(t)) for t in texts.to_pylist()]
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(ends), pa.array([i for x in ids for i in x], pa.int32()))
        texts = pc.replace_substring(texts.cast(pa.large_string()), SPACE, " ")
        if self.v.collapse:
            texts = pc.replace_substring_regex(pc.utf8_trim(texts, " "), " +", " ")
        if self.v.prefix:
            texts = pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string())))
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        solid = data[offsets[0] : offsets[-1]] != 32
        begins = np.zeros(len(solid) + 1, bool)  # a word: spaces, and what follows them up to the next space
        begins[1:-1] = solid[:-1] & ~solid[1:]
        begins[offsets - offsets[0]] = True
        begins = np.flatnonzero(begins[:-1])
        words = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(np.append(begins, len(solid)).astype(np.int64)), pa.py_buffer(data[offsets[0] : offsets[-1]])).dictionary_encode()
        get, found = self.words.get, []
        for word in words.dictionary.to_pylist():
            word = word.replace(" ", SPACE)
            ids = get(word)
            if ids is None:
                ids = self._part(word, True)
                get = self.words.get
            found.append(ids)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum()))
        which = words.indices.to_numpy()
        ends = np.concatenate([[0], np.cumsum(sizes[which])])
        at = np.arange(ends[-1]) + np.repeat((np.cumsum(sizes) - sizes)[which] - ends[:-1], sizes[which])
        return pa.ListArray.from_arrays(pa.array(ends[np.searchsorted(begins, offsets - offsets[0])].astype(np.int32)), pa.array(flat[at]))

    def _part(self, text: str, cut: bool) -> tuple[int, ...]:
        """The ids of a word that isn't among the recent ones. Where no piece has its neighbouring characters in a row, no
        path crosses; the parts between such places are looked up on their own."""
        ids = self.older.get(text)
        if ids is None and cut:
            near = self.v.near
            at = [0, *[k for k in range(1, len(text)) if text[k - 1 : k + 1] not in near], len(text)]
            if len(at) > 2:
                ids = sum([self.words.get(x) or self._part(x, False) for x in map(text.__getitem__, map(slice, at, at[1:]))], ())
        if ids is None:
            ids = self.ids_of(text)
        if len(text) < 64:
            if len(self.words) >= KEPT_WORDS:
                self.older, self.words = self.words, {}
            self.words[text] = ids
        return ids

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """The text of each list of ids (without nulls). Bytes that are no UTF-8 give U+FFFD."""
        taken = self.v.bytes_of.take(ids.flatten())
        at = np.asarray(ids.offsets) - ids.offsets[0].as_py()
        _, offsets, data = taken.buffers()
        offsets = np.frombuffer(offsets, np.int64)[taken.offset : taken.offset + len(taken) + 1][at]
        out = pa.LargeStringArray.from_buffers(len(ids), pa.py_buffer(offsets), data if data is not None else pa.py_buffer(b""))
        try:
            out.validate(full=True)
        except pa.ArrowInvalid:
            out = pa.array([x.decode("utf-8", "replace") for x in out.cast(pa.large_binary()).to_pylist()], pa.large_string())
        if self.v.prefix:
            out = pc.if_else(pc.starts_with(out, " "), pc.utf8_slice_codeunits(out, 1), out)
        return out


_encoders: dict[int, Encoder] = {}


def _encoder(sent) -> Encoder:
    """One encoder for each worker process and model, so that its words outlast a batch."""
    key = hash(sent.value)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(Vocabulary(sent.value))
    return _encoders[key]


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Rows of about SLICE_BYTES of a column at a time, or one larger row, which bounds what a worker holds."""
    sizes = batch.column(column).nbytes / max(1, batch.num_rows)
    if sizes * batch.num_rows <= SLICE_BYTES:
        yield batch
        return
    values = batch.column(column)
    each = pc.binary_length(values) if not pa.types.is_list(values.type) else pc.multiply(pc.list_value_length(values), 4)
    ends = np.cumsum(each.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    row = 0
    while row < batch.num_rows:
        last = max(row + 1, int(np.searchsorted(ends, (ends[row - 1] if row else 0) + SLICE_BYTES, "right")))
        yield batch.slice(row, last - row)
        row = last


def encode(docs: DataFrame, model: bytes, *, text_col: str = "text") -> DataFrame:
    """docs with ids (array<int>): the pieces of each whole text. A null or empty text has none.

    Narrow: nothing is shuffled. Rows that repeat get equal results. A column named ids gives way to the result, other
    columns stay; texts are taken SLICE_BYTES at a time, or one longer text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    text = text_or_empty(text_col)
    rest = without(docs, "ids")
    at = len(rest.columns)
    schema = T.StructType([*rest.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches):
        coder = _encoder(sent)
        for whole in batches:
            for batch in slices(whole, at):
                yield pa.RecordBatch.from_arrays([*batch.columns[:at], coder.encode(batch.column(at))], [*batch.schema.names[:at], "ids"])

    return docs.select(*columns(rest), text.alias(unused(docs, "text"))).mapInArrow(run, schema)


def decode(docs: DataFrame, model: bytes, *, ids_col: str = "ids", to: str = "decoded") -> DataFrame:
    """docs with the text of ids_col in column `to`; null for null ids. The inverse of encode for models whose
    normalisation keeps the text. Rows that repeat get equal results; a column named `to` gives way, other columns stay."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rest = without(docs, to)
    at = len(rest.columns)
    schema = T.StructType([*rest.schema.fields, T.StructField(to, T.StringType())])

    def run(batches):
        coder = _encoder(sent)
        for whole in batches:
            for batch in slices(whole, at):
                lists = batch.column(at)
                texts = coder.decode(lists.fill_null([]) if lists.null_count else lists).cast(pa.string())
                if lists.null_count:
                    texts = pc.if_else(lists.is_valid(), texts, None)
                yield pa.RecordBatch.from_arrays([*batch.columns[:at], texts], [*batch.schema.names[:at], to])

    return docs.select(*columns(rest), F.col(ids_col).alias(unused(docs, "ids"))).mapInArrow(run, schema)
