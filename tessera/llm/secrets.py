"""Secret scan: an Aho-Corasick keyword prefilter, anchored patterns near its hits, checksum validation.

One automaton runs over the lower-cased bytes of each whole text and finds keywords; a second runs over
an image of the text in which every lower-case hex digit is the same byte, where a long hex run is a
keyword too. A pattern is tried only at a hit, anchored there. Text without a hit is never matched.

Kinds, in listed order. Base kinds keep every match that is long enough:

* ``assign``: a keyword, an optional quote, ``:`` or ``=``, an optional quote, and a value of 6 or more
  characters; the span holds all of it;
* ``access``: ``AKIA`` and capitals or digits, 20 or more characters;
* ``hex``: a run of 24 or more lower-case hex digits.

Kinds that carry a checksum of their own keep a match only if that holds:

* ``github``: ``ghp_ gho_ ghu_ ghs_ ghr_``, 30 base-62 characters and the CRC-32 of those as 6 base-62 digits;
* ``npm``: ``npm_`` and the same.

Matches of a kind are leftmost and do not overlap; those of different kinds may. Positions count code
points, the end exclusive.

Defined results: null or empty text has no spans; repeated rows give repeated results; other columns are
never read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import common

#: Kinds in listed order.
KINDS = ("assign", "access", "hex", "github", "npm")
BASE = KINDS[:3]
HEX_LEAST = 24
#: The base-62 digits of the checksummed token formats, in order of value.
BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

#: The patterns, over UTF-8 bytes; all are anchored at a keyword.
ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
CHECKED = {"github": re.compile(rb"gh[pousr]_([0-9A-Za-z]{36})(?![0-9A-Za-z])"), "npm": re.compile(rb"npm_([0-9A-Za-z]{36})(?![0-9A-Za-z])")}

#: Keywords and the kind whose pattern starts there.
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign",
    "akia": "access",
    "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github",
    "npm_": "npm",
}
#: In the image, hex digits become this byte and itself becomes another.
MARK = b"h"
IMAGE = bytes(MARK[0] if c in b"0123456789abcdef" else (ord(".") if c == MARK[0] else c) for c in range(256))


def crc_holds(body: bytes) -> bool:
    """Whether the last 6 base-62 digits are the CRC-32 of what stands before them."""
    value = 0
    for c in body[-6:]:
        value = value * 62 + BASE62.index(c)
    return value == zlib.crc32(body[:-6])


def scanner() -> Callable[[str | None], list[tuple[str, int, int]]]:
    """The function from a text to its spans (kind, start, end), by start, then kind as listed."""
    import ahocorasick

    words, runs = ahocorasick.Automaton(), ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        words.add_word(word, (kind, len(word)))
    runs.add_word(MARK.decode() * HEX_LEAST, HEX_LEAST)
    words.make_automaton()
    runs.make_automaton()

    def matched(kind: str, data: bytes, at: int) -> int:
        """The end of the kind's match at ``at`` whether kept or not, negative if it is dropped, 0 if there is none."""
        if kind == "assign":
            m = ASSIGN.match(data, at)
            return 0 if m is None else m.end() if len(m[1]) >= 6 else -m.end()
        if kind == "access":
            m = ACCESS.match(data, at)
            return 0 if m is None else m.end() if m.end() - at >= 20 else -m.end()
        m = CHECKED[kind].match(data, at)
        return m.end() if m and crc_holds(m[1]) else 0

    def scan(text: str | None) -> list[tuple[str, int, int]]:
        if not text:
            return []
        data = text.encode("utf-8", "surrogatepass")
        found: list[tuple[str, int, int]] = []
        done = dict.fromkeys(KINDS, 0)
        for last, (kind, n) in words.iter(data.lower().decode("latin-1")):
            at = last + 1 - n
            if at >= done[kind] and (end := matched(kind, data, at)):
                done[kind] = abs(end)
                if end > 0:
                    found.append((kind, at, end))
        for last, n in runs.iter(data.translate(IMAGE).decode("latin-1")):
            if last >= done["hex"]:
                end = HEX.match(data, last).end()
                done["hex"] = end
                found.append(("hex", last + 1 - n, end))
        if not found:
            return []
        found.sort(key=lambda x: (x[1], KINDS.index(x[0])))
        return found if len(data) == len(text) else points(data, found)

    def points(data: bytes, found: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
        """Spans in bytes, by start, as spans in code points; matches are ASCII, so one pass counts what stands between the starts."""
        out, at, before = [], 0, 0
        for kind, start, end in found:
            before += len(data[at:start].decode("utf-8", "surrogatepass"))
            at = start
            out.append((kind, before, before + end - start))
        return out

    return scan


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the key and ``spans``, an array of (kind, start, end) by start, then kind as listed."""
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def make():
        scan = scanner()

        def work(texts: list) -> list:
            rows = [[{"kind": k, "start": a, "end": b} for k, a, b in scan(t)] for t in texts]
            return [pa.array(rows, pa.list_(kind))]

        return work

    return common.map_texts(docs, [key], text, [T.StructField("spans", T.ArrayType(SPAN))], make)


def digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts and digests of ``find_secrets``'s rows."""
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s.kind.isin(*BASE))
    return found.select(key, *[count(k) for k in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
