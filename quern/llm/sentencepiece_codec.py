"""SentencePiece BPE encoding and decoding in vectorised merge rounds.

No piece holds a space mark after another character, so merges never cross the
start of a run of spaces: texts fall into words there, and equal words of a
batch are encoded once.  All words sit in one flat array of symbols.  A round
finds each word's smallest pair rank (a segmented minimum, leftmost on ties),
merges there in all words at once, closes the gaps, and looks up the two pairs
that changed; words without a pair leave.  A word of over ``LONG`` symbols (text
without spaces) would take as many rounds as it has merges.  Its rounds take the
minimum over a neighbourhood instead of the word: whatever could reach a pair before
its turn begins with a pair of smaller rank within the longest piece's length, so a
pair that is smallest there merges now, in all neighbourhoods at once.

The model file is read on the driver and travels as bytes; only BPE models with
byte fallback and the identity normaliser are accepted.  Memory is bounded by a
chunk of texts or one text.

Defined results.  A null text is an empty one: begin and end ids, decoded "".
Rows with equal, repeated or null ids are encoded on their own.  Only the id and
text columns are read.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import buffers, chunks

SPACE = "▁"
LONG = 400
CHUNK_BYTES = 2 << 20
_NONE = np.int64(2**62)
_PLACE = np.int64(40)


def _fields(data: bytes):
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if kind == 2 else 8 if kind == 1 else 4
            yield tag >> 3, data[at : at + size]
            at += size


class Codec:
    """Encoder and decoder of one model."""

    def __init__(self, model: bytes) -> None:
        pieces, scores, kinds, trainer, normalizer = [], [], [], {}, {}
        for number, value in _fields(model):
            if number == 1:
                piece = dict(_fields(value))
                pieces.append(piece.get(1, b""))
                scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                kinds.append(piece.get(3, 1))
            elif number in (2, 3):
                (trainer if number == 2 else normalizer).update(_fields(value))
        if trainer.get(3, 1) != 2 or not trainer.get(35, 0) or normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(3, 1):
            raise ValueError("only BPE models with byte fallback, a dummy prefix and the identity normaliser are supported")
        self.size = n = len(pieces)
        self.begin, self.end = trainer.get(41, 1), trainer.get(42, 2)
        if any(k in (4, 5) for k in kinds):
            raise ValueError("models with user-defined or unused pieces are not supported")
        own = {pieces[i].decode(): i for i in range(n) if kinds[i] == 1}
        if any(SPACE in p.lstrip(SPACE) for p in own):
            raise ValueError("models whose pieces hold inner space marks are not supported")
        self.symbol = np.arange(n, n + 0x110000, dtype=np.int64)
        for p, i in own.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        self.symbol[0x20] = self.symbol[ord(SPACE)]
        order = {s: r for r, s in enumerate(sorted({scores[i] for i in own.values()}, reverse=True))}
        self.rank = np.zeros(n, np.int64)
        self.rank[list(own.values())] = [order[scores[i]] for i in own.values()]
        keys, merged = [], []
        for p, i in own.items():
            for k in range(1, len(p)):
                if p[:k] in own and p[k:] in own:
                    keys.append(own[p[:k]] * n + own[p[k:]])
                    merged.append(i)
        self._table(np.array(keys, np.int64), np.array(merged, np.int64))
        self.reach = max(len(p) for p in own)
        #: Pieces that some pair of no greater rank takes up: after each merge of one, order has to be looked at anew.
        self.early = np.zeros(n, bool)
        made = np.array(merged, np.int64)
        for part in (np.array(keys, np.int64) // n, np.array(keys, np.int64) % n):
            single = self.rank[part]
            self.early[part[(self.rank[made] <= single) & self._is_made(part, made)]] = True
        self.byte = np.zeros(256, np.int64)
        surface = []
        for i in range(n):
            if kinds[i] == 6:
                value = int(pieces[i][3:5], 16)
                self.byte[value] = i
                surface.append(bytes([value]))
            elif kinds[i] == 3:
                surface.append(b"")
            elif kinds[i] == 2:
                surface.append(trainer.get(44, " ⁇ ".encode()))
            else:
                surface.append(pieces[i].replace(SPACE.encode(), b" "))
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.surface_at = np.concatenate([[0], np.cumsum([len(x) for x in surface])])

    def _table(self, keys: np.ndarray, merged: np.ndarray) -> None:
        """Pairs by open addressing; the table is sparse, so nearly all lookups end at once."""
        bits = max(10, int(len(keys) * 8).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.merged = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)
        for slot, key, value in zip(self._slot(keys).tolist(), keys.tolist(), merged.tolist(), strict=True):
            while self.keys[slot] >= 0:
                slot = (slot + 1) & self.mask
            self.keys[slot], self.merged[slot] = key, value

    @staticmethod
    def _is_made(part: np.ndarray, merged: np.ndarray) -> np.ndarray:
        """Whether each piece is itself made of a pair."""
        return np.isin(part, merged)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each two symbols make, or -1."""
        out = np.full(len(left), -1, np.int64)
        at = np.flatnonzero((left < self.size) & (right < self.size))
        keys = left[at] * self.size + right[at]
        slots = self._slot(keys)
        while len(at):
            there = self.keys[slots]
            hit = there == keys
            out[at[hit]] = self.merged[slots[hit]]
            more = ~hit & (there >= 0)
            at, keys, slots = at[more], keys[more], (slots[more] + 1) & self.mask
        return out

    def _order(self, pieces: np.ndarray, places: np.ndarray) -> np.ndarray:
        return np.where(pieces >= 0, (self.rank[pieces] << _PLACE) | places, _NONE)

    def merge(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge rounds over words of the given lengths; all symbols that are left, and how many a word has."""
        words = np.repeat(np.arange(len(lengths)), lengths)
        long = lengths[words] > LONG
        done_words, done_symbols = [], []
        if long.any():
            left, of = self._merge_long(symbols[long], words[long])
            done_words.append(of)
            done_symbols.append(left)
            symbols, words = symbols[~long], words[~long]
        made = self._made(symbols, words)
        while len(symbols):
            starts = np.flatnonzero(np.append(True, words[1:] != words[:-1]))
            best = np.minimum.reduceat(self._order(made, np.arange(len(symbols))), starts)
            going = best < _NONE
            if not going.all():
                stay = np.repeat(going, np.diff(np.append(starts, len(symbols))))
                done_words.append(words[~stay])
                done_symbols.append(symbols[~stay])
                shift = np.cumsum(~stay)
                places = best[going] & ((np.int64(1) << _PLACE) - 1)
                places = places - shift[places]
                symbols, words, made = symbols[stay], words[stay], made[stay]
            else:
                places = best & ((np.int64(1) << _PLACE) - 1)
            if not len(symbols):
                break
            symbols, words, made = self._merged(symbols, words, made, places)
        if not done_words:
            return symbols, np.zeros(len(lengths), np.int64)
        words, symbols = np.concatenate(done_words), np.concatenate(done_symbols)
        order = np.argsort(words, kind="stable")
        return symbols[order], np.bincount(words, minlength=len(lengths))

    def _made(self, symbols: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The piece that each symbol makes with the next one of its word, or -1."""
        made = np.full(len(symbols), -1, np.int64)
        at = np.flatnonzero(words[1:] == words[:-1])
        made[at] = self.pairs(symbols[at], symbols[at + 1])
        return made

    def _merged(self, symbols: np.ndarray, words: np.ndarray, made: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(symbols, words, made) after the pairs at ``places`` (ascending, not overlapping) have merged."""
        symbols[places] = made[places]
        keep = np.ones(len(symbols), bool)
        keep[places + 1] = False
        places = places - np.arange(len(places))
        symbols, words, made = symbols[keep], words[keep], made[keep]
        made[places] = -1
        changed = np.concatenate([places[places > 0] - 1, places[places < len(symbols) - 1]])
        made[changed] = -1
        changed = changed[words[changed] == words[changed + 1]]
        made[changed] = self.pairs(symbols[changed], symbols[changed + 1])
        return symbols, words, made

    def _merge_long(self, symbols: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, words) after all merges of long words; in a round every pair merges that is smallest around itself.

        Of equal pairs in a row every other one merges, from the row's first, as one after the other would.
        """
        made = self._made(symbols, words)
        while (made >= 0).any():
            order = self._order(made, np.arange(len(symbols)))
            # The minimum over ``reach`` symbols either way; another word's pairs can only make a pair wait.
            low = np.concatenate([np.full(self.reach, _NONE), order, np.full(self.reach, _NONE)])
            width, span = 1, 2 * self.reach + 1
            while 2 * width <= span:
                low = np.minimum(low[:-width], low[width:])
                width *= 2
            low = np.minimum(low[: len(order)], low[span - width : span - width + len(order)])
            first = order == low
            ready = (made >= 0) & ((order >> _PLACE) == (low >> _PLACE)) & (first | ~self.early[made])
            chain = np.zeros(len(order), bool)
            chain[1:] = (made[1:] >= 0) & (order[1:] >> _PLACE == order[:-1] >> _PLACE) & (made[:-1] >= 0) & (words[1:] == words[:-1])
            head = np.maximum.accumulate(np.where(chain, 0, np.arange(len(order))))
            # A pair of a row merges if all before it in the row are ready, at even distance from the first.
            blocked = np.concatenate([[0], np.cumsum(~ready)])
            places = np.flatnonzero(ready & (blocked[1:] == blocked[head]) & ((np.arange(len(order)) - head) % 2 == 0))
            symbols, words, made = self._merged(symbols, words, made, places)
        return symbols, words

    def encode_words(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and where each word's begin."""
        data, offsets = buffers(words)
        lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        symbols, counts = self.merge(self.symbol[points], np.diff(lead[offsets]))
        ends = np.cumsum(counts)
        unknown = symbols >= self.size
        if unknown.any():
            text = [chr(x - self.size).encode() for x in symbols[unknown].tolist()]
            each = np.ones(len(symbols), np.int64)
            each[unknown] = [len(x) for x in text]
            wide = np.repeat(symbols, each)
            wide[np.repeat(unknown, each)] = self.byte[np.frombuffer(b"".join(text), np.uint8)]
            ends = np.concatenate([[0], np.cumsum(each)])[ends]
            symbols = wide
        return symbols, np.concatenate([[0], ends])

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (little-endian, 32 bits) with begin and end ids, and where each text's begin."""
        texts = pc.replace_substring(pc.fill_null(column, ""), SPACE, " ")
        texts = pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, pc.binary_join_element_wise(pa.scalar(" ", texts.type), texts, pa.scalar("", texts.type)))
        data, offsets = buffers(texts)
        space = data == 0x20
        starts = space.copy()
        starts[1:] &= ~space[:-1]
        starts[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        starts = np.flatnonzero(starts)
        places = np.append(starts, len(data)).astype(np.int32)
        words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(places), pa.py_buffer(data.tobytes())).dictionary_encode()
        ids, at = self.encode_words(words.dictionary)
        which = words.indices.to_numpy()
        counts = (at[1:] - at[:-1])[which]
        ends = np.concatenate([[0], np.cumsum(counts)])
        flat = ids[np.repeat(at[:-1][which] - ends[:-1], counts) + np.arange(ends[-1])]
        inner = ends[np.searchsorted(starts, offsets)]
        n = len(offsets) - 1
        bounds = inner + 2 * np.arange(n + 1)
        out = np.empty(bounds[-1], "<u4")
        out[bounds[:-1]], out[bounds[1:] - 1] = self.begin, self.end
        body = np.ones(len(out), bool)
        body[bounds[:-1]] = body[bounds[1:] - 1] = False
        out[body] = flat
        return out, bounds

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """UTF-8 text of each run of ids: the dummy prefix goes, bytes that are no UTF-8 are replaced."""
        ids = ids.astype(np.int64)
        counts = (self.surface_at[1:] - self.surface_at[:-1])[ids]
        ends = np.concatenate([[0], np.cumsum(counts)])
        flat = self.surface[np.repeat(self.surface_at[:-1][ids] - ends[:-1], counts) + np.arange(ends[-1])].tobytes()
        cut = ends[bounds].tolist()
        out = []
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            text = flat[a + (flat[a : a + 1] == b" " and a < b) : b]
            try:
                text.decode()
            except UnicodeDecodeError:
                text = text.decode("utf-8", "replace").encode()
            out.append(text)
        return out


_CODECS: dict[bytes, Codec] = {}


def codec_of(model: bytes) -> Codec:
    """The model's codec, built once in each worker process."""
    key = hashlib.sha256(model).digest()
    if key not in _CODECS:
        _CODECS[key] = Codec(model)
    return _CODECS[key]


def _read(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def _encoded(batch: pa.RecordBatch, codec: Codec):
    """(first row, past the last, ids, bounds) of chunks of a batch's second column."""
    column = pc.fill_null(batch.column(1), "")
    _, offsets = buffers(column)
    for a, b in chunks(offsets, offsets, CHUNK_BYTES):
        yield a, b, *codec.encode(column.slice(a, b - a))


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the ids of each whole text, begin and end ids included."""
    model = _read(model_path)

    def run(batches):
        codec = codec_of(model)
        for batch in batches:
            for a, b, ids, bounds in _encoded(batch, codec):
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of lists of ids; a null list is an empty one."""
    model = _read(model_path)

    def run(batches):
        codec = codec_of(model)
        for batch in batches:
            lists = pc.fill_null(batch.column(1), [])
            bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
            texts = codec.decode(pc.list_flatten(lists).to_numpy(zero_copy_only=False), bounds)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t.decode() for t in texts], pa.string())], ["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def round_trip_digest(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encodes every text and decodes the ids again, in one pass."""
    model = _read(model_path)

    def run(batches):
        codec = codec_of(model)
        for batch in batches:
            for a, b, ids, bounds in _encoded(batch, codec):
                raw, cut = ids.tobytes(), (bounds * 4).tolist()
                of_ids = [hashlib.sha256(raw[x:y]).hexdigest() for x, y in zip(cut[:-1], cut[1:], strict=True)]
                of_text = [hashlib.sha256(t).hexdigest() for t in codec.decode(ids, bounds)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(bounds)), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
