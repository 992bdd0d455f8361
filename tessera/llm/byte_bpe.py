"""Byte-level BPE with the tokenizers library over Arrow batches, and its inverse.

The vocabulary is a rank file (base64 token, rank). Every byte has a printable stand-in character
(the byte table), so the library's BPE model works on characters while the tokens are byte strings.
Its merges are derived from the ranks: every way to split a token into two tokens of lower rank is a
merge with that token's priority, the longer left part first.

Each distinct piece of text (a match of the split pattern) is encoded by the library and kept in a memo
bounded in bytes; a document is the concatenation of its pieces. The pieces come from the ``regex`` module
where it agrees with the library's own splitter (SAFE); a text with any other character goes through the
library as a whole. ``digested`` takes the digests where the ids are, so that no ids travel.

Defined results: a null text is the empty text (no ids, empty bytes); empty text likewise; repeated rows
give repeated results; columns other than the id and the text are never read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from . import common

#: Ranges on which both splitters know every character's class; others change with the Unicode version.
SAFE = r"\x00-\u0557\u2000-\u208e\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"
#: Bytes of each half of a worker's memo; when the young half is full it becomes the old one, which is then let go.
MEMO = 12_000_000
#: Characters of a piece that is kept at most, and the fixed share of an entry's size.
KEPT, ENTRY = 64, 200


def byte_table() -> list[str]:
    """The stand-in character of each byte: printable Latin-1 bytes stand for themselves, the rest follow from U+0100."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class ByteBPE:
    """A tokenizer for one rank file and split pattern."""

    def __init__(self, path: str, pattern: str) -> None:
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        table = byte_table()
        self.table = dict(enumerate(table))
        shown = {token: "".join(table[b] for b in token) for token in ranks}
        merges = []
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            for cut in range(len(token) - 1, 0, -1):
                left, right = token[:cut], token[cut:]
                if ranks.get(left, rank) < rank and ranks.get(right, rank) < rank:
                    merges.append((shown[left], shown[right]))
        self.library = Tokenizer(models.BPE(vocab={shown[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
        self.library.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.Split(Regex(pattern), behavior="isolated"),
            pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
        ])
        back = {c: b for b, c in enumerate(table)}
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = bytes(back[c] for c in shown[token])
        self.pieces = regex.compile(pattern).findall
        self.strange = re.compile(f"[^{SAFE}]").search
        self.decimals = [b"%d" % i for i in range(len(self.bytes_of))]
        self.numbers = list(range(len(self.bytes_of)))
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}
        self.held = 0

    def _of(self, piece: str) -> tuple[int, ...]:
        """The ids of a piece that the young half has not."""
        ids = self.old.get(piece)
        if ids is None:
            shown, numbers = piece.encode().decode("latin-1").translate(self.table), self.numbers
            ids = tuple([numbers[token.id] for token in self.library.model.tokenize(shown)])
        if len(piece) <= KEPT:
            self.held += ENTRY + 4 * len(piece) + 8 * len(ids)
            if self.held > MEMO:
                self.old, self.young, self.held = self.young, {}, 0
            self.young[piece] = ids
        return ids

    def encode(self, text: str) -> Iterator[int]:
        """The ids of a whole text."""
        if not text.isascii() and self.strange(text):
            return iter(self.library.encode(text, add_special_tokens=False).ids)
        young, of = self.young.get, self._of
        found = []
        for piece in self.pieces(text):
            ids = young(piece)
            if ids is None:
                ids = of(piece)
                young = self.young.get
            found.append(ids)
        return chain.from_iterable(found)

    def digests(self, text: str) -> tuple[int, str, str]:
        """The number of ids, the SHA-256 of the ids as decimals joined by commas, and that of the bytes they decode to."""
        ids = list(self.encode(text))
        return len(ids), hashlib.sha256(b",".join(map(self.decimals.__getitem__, ids))).hexdigest(), hashlib.sha256(self.decode(ids)).hexdigest()

    def decode(self, ids) -> bytes:
        """The bytes of ids. An id outside the vocabulary raises IndexError."""
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def offsets(self, ids) -> list[tuple[int, int, int, int]]:
        """Per token: start and end in bytes, and the characters it touches, start and end; a character split over tokens belongs to each of them."""
        data = self.decode(ids)
        character = np.cumsum(np.fromiter((b & 0xC0 != 0x80 for b in data), bool, len(data))) - 1 if data else np.zeros(0, int)
        ends = list(accumulate(len(self.bytes_of[i]) for i in ids))
        return [(start, end, int(character[start]), int(character[end - 1]) + 1) for start, end in zip([0, *ends], ends, strict=False)]

    def decode_parts(self, ids) -> Iterator[str]:
        """Text token by token; bytes of a character that is split over tokens are held until its last token."""
        held = b""
        for i in ids:
            held += self.bytes_of[i]
            try:
                yield held.decode()
                held = b""
            except UnicodeDecodeError as e:
                cut = e.start if e.reason == "unexpected end of data" else len(held)
                yield held[:cut].decode(errors="replace")
                held = held[cut:]
        if held:
            yield held.decode(errors="replace")


@lru_cache(maxsize=4)
def tokenizer(path: str, pattern: str) -> ByteBPE:
    return ByteBPE(path, pattern)


def encode_decode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row of ``docs``: key, ``keep``, ids array<int>, decoded binary (the bytes of those ids)."""

    def make():
        bpe = tokenizer(path, pattern)

        def work(texts: list) -> list:
            ids = [np.fromiter(bpe.encode(t or ""), np.int32) for t in texts]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            return [pa.ListArray.from_arrays(ends, flat), pa.array([bpe.decode(x.tolist()) for x in ids], pa.binary())]

        return work

    fields = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())]
    return common.map_texts(docs, [key, *keep], text, fields, make)


def digested(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row of ``docs``: key, ``keep``, n_tokens, ids_sha256, decoded_sha256; what ``digests`` makes of ``encode_decode``'s rows."""

    def make():
        bpe = tokenizer(path, pattern)

        def work(texts: list) -> list:
            rows = [bpe.digests(t or "") for t in texts]
            return [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())]

        return work

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return common.map_texts(docs, [key, *keep], text, fields, make)


def digests(coded: DataFrame, key: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """The digest columns of ``encode_decode``'s rows."""
    return coded.select(
        key, *keep,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
