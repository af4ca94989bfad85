"""Op 7. Byte-level BPE by dynamic programming over prefixes.

For every byte prefix of a piece there is exactly one token that can end its encoding: the token t ending there whose pair with
the last token of the prefix before t survives merging on its own. PrefixTable stores that token for each prefix, so the
encoding of any prefix is read off backwards, bytes can be appended without redoing what stands before, and an edit only redoes
the prefixes from the edit to the place where the old and new tables agree again.

Whole texts are cut by the tokenizer's pattern and each match is encoded separately, without special tokens. Encodings of
pieces are remembered in a bounded table per worker; forgetting costs time only. A null text is empty: no tokens. Repeated rows
are encoded alike, empty tables give empty results, other columns are carried along except that one named like a result (in
whatever case) gives way. A very long text is cut into stretches between pieces; its tokens are held whole, four bytes each.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import carried
from .words import slices

#: Pieces remembered by a worker before they age, and again until they go; characters cut into pieces at once.
REMEMBERED, STRETCH = 200_000, 1 << 20


class Vocabulary:
    """Ranks of a byte-level BPE, and which tokens may stand beside each other."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes: list[bytes] = [b""] * (max(ranks.values()) + 1)
        self.ends = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.bytes[rank] = token
            self.ends.add_word(token.decode("latin-1"), rank)
        self.ends.make_automaton()
        self.length = list(map(len, self.bytes))
        self.longest = max(self.length)
        self.decimal = [str(i) for i in range(len(self.bytes))]
        self._whole: dict[int, bool] = {}
        self._pair: dict[tuple[int, int], bool] = {}

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def merge(self, data: bytes) -> list[int]:
        """Plain merging by rank; only ever called on one or two tokens' bytes."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            least, at = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if least == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def whole(self, t: int) -> bool:
        """Whether merging the token's own bytes gives it."""
        known = self._whole.get(t)
        if known is None:
            known = self._whole[t] = self.merge(self.bytes[t]) == [t]
        return known

    def pair(self, a: int, b: int) -> bool:
        """Whether merging leaves the two tokens apart."""
        known = self._pair.get((a, b))
        if known is None:
            if len(self._pair) > 1_000_000:
                self._pair.clear()
            known = self._pair[a, b] = self.merge(self.bytes[a] + self.bytes[b]) == [a, b]
        return known


class PrefixTable:
    """last[i]: the token that ends the encoding of the first i bytes; last[0] is -1."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def append(self, data: bytes) -> None:
        self.data += data
        self._fill(len(self.last))

    def _fill(self, first: int, stop=None) -> int:
        """Fill last from prefix `first` on; stop(i) may end it early. Returns the prefix after the last one filled."""
        v, last, length = self.vocabulary, self.last, self.vocabulary.length
        last += [-1] * (len(self.data) + 1 - len(last))
        back = max(0, first - v.longest)
        if stop is None:  # the common case, with nothing but what it needs
            pair, known = v.pair, v._pair.get
            for at, t in v.ends.iter(self.data[back:].decode("latin-1")):
                i = back + at + 1
                if i < first or last[i] >= 0:
                    continue
                j = i - length[t]
                if j:
                    apart = known((last[j], t))
                    if pair(last[j], t) if apart is None else apart:
                        last[i] = t
                elif v.whole(t):
                    last[i] = t
            return len(self.data) + 1
        done = checked = first - 1
        for at, t in v.ends.iter(self.data[back:].decode("latin-1")):
            i = back + at + 1
            if i < first or i == done and last[i] >= 0:
                continue
            if stop and i > done > checked:
                checked = done
                if stop(done):
                    return done + 1
            j = i - length[t]
            if j == 0 and v.whole(t) or j > 0 and v.pair(last[j], t):
                last[i], done = t, i
        return done + 1

    def tokens(self, end: int | None = None) -> list[int]:
        """The encoding of the first `end` bytes."""
        out, i = [], len(self.data) if end is None else end
        while i:
            out.append(self.last[i])
            i -= self.vocabulary.length[self.last[i]]
        return out[::-1]

    def edit(self, start: int, end: int, new: bytes) -> int:
        """Put new in place of the bytes start:end. Returns how many prefixes were redone: the rest follow from the old table,
        once as many prefixes in a row as the longest token has bytes are as they were."""
        old, tail, longest = self.last, self.data[end:], self.vocabulary.longest
        shift = start + len(new) - end
        self.data = self.data[:start] + new + tail
        self.last = old[: start + 1]
        self.last += [-1] * (len(self.data) + 1 - len(self.last))
        same = 0

        def settled(i: int) -> bool:
            nonlocal same
            fresh = i > start + len(new) and self.last[i] == old[i - shift]
            same = same + 1 if fresh else 0
            return same >= longest

        upto = self._fill(start + 1, settled)
        for i in range(upto, len(self.data) + 1):
            self.last[i] = old[i - shift]
        return upto - start - 1


class Encoder:
    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary, self.pieces = vocabulary, regex.compile(pattern)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def piece(self, piece: str) -> bytes:
        """Token ids of one piece as packed int32."""
        packed = self.older.get(piece)
        if packed is None:
            data = piece.encode()
            whole = self.vocabulary.ranks.get(data)
            packed = array("i", [whole] if whole is not None else PrefixTable(self.vocabulary, data).tokens()).tobytes()
        if len(piece) <= 64:
            if len(self.known) >= REMEMBERED:
                self.known, self.older = {}, self.known
            self.known[piece] = packed
        return packed

    def stretches(self, text: str) -> Iterator[str]:
        """Parts of the text that pieces never cross: each ends between an ASCII letter and a space."""
        at = 0
        while len(text) - at > STRETCH:
            cut = at + STRETCH
            while 0 <= (cut := text.find(" ", cut)) and not (text[cut - 1].isascii() and text[cut - 1].isalpha()):
                cut += 1
            if cut < 0:
                break
            yield text[at:cut]
            at = cut
        yield text[at:]

    def encode(self, text: str) -> np.ndarray:
        out = []
        for part in self.stretches(text):
            found = self.pieces.findall(part)
            get, piece = self.known.get, self.piece
            out.append(b"".join([get(p) or piece(p) for p in found]))
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.vocabulary.bytes.__getitem__, ids.tolist()))


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """The process's encoder for a file that every machine has, as libraries are installed on each."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = Encoder(Vocabulary.load(path), pattern)
    return _ENCODERS[path, pattern]


def encode_texts(docs: DataFrame, path: str, pattern: str, text_col: str = "text", ids: bool = False) -> DataFrame:
    """docs with n_tokens, ids_sha256 and decoded_sha256 and, if asked, token_ids; columns of those names give way."""
    own = ["n_tokens", "ids_sha256", "decoded_sha256", *(["token_ids"] if ids else [])]
    rest = carried(docs, own)
    at = rest.index(text_col)
    rows = docs.select(*[F.col(f"`{c}`") for c in rest])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        name = e.vocabulary.decimal.__getitem__
        for batch in batches:
            for i, j in slices(batch.column(at), 8 << 20):
                part = batch.slice(i, j - i)
                n, a, b, tokens = [], [], [], []
                for text in part.column(at).to_pylist():
                    found = e.encode(text or "")
                    n.append(len(found))
                    a.append(hashlib.sha256(" ".join(map(name, found.tolist())).encode()).hexdigest())
                    b.append(hashlib.sha256(e.decode(found)).hexdigest())
                    if ids:
                        tokens.append(found)
                new = [pa.array(n, pa.int64()), pa.array(a), pa.array(b), *([pa.array(tokens, pa.list_(pa.int32()))] if ids else [])]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], [*rest, *own])

    kinds = {"n_tokens": T.LongType(), "token_ids": T.ArrayType(T.IntegerType())}
    schema = T.StructType([*rows.schema.fields, *(T.StructField(c, kinds.get(c, T.StringType())) for c in own)])
    return rows.mapInArrow(run, schema)
