"""Main text of web pages by equivalence-class template deduction.

A page is a sequence of tokens: tags with their place in the tree, and whole text nodes. Tokens of one host's
pages that have the same occurrence vector (how often they occur on each page) are an equivalence class. A
class is a candidate if it has ``LEAST_TOKENS`` tokens, a tag among them (two where it occurs on less than half
of the host's pages), and occurs on ``LEAST_PAGES`` pages of the host and on one in ``LEAST_SHARE`` of them at
least, on different ones. So a host with several types of pages has classes of each type.

Candidates are then held against the pages: the host's main class, that of most pages, cuts a page into slots,
and a token stays in its class only if it stands in the same slot and at the same place within its class on all
pages. What is left, classes nested in the main class's slots, is the host's template.

The template decides what is extracted. A text node that is a template token is the host's furniture. Class and
id words (``FURNITURE``) label an element as menu, notice, advert, comments and the like if its tag is a token of
the template; elements that only one page has are no slots of it. By the meaning of HTML itself, scripts,
styles, forms, nav, aside, footer and page headers are never content. All other slots are the main text, on
every page, without blocks that are nothing but furniture. An article (or main) element is a hint: a repeated
passage in it is taken for content, and labels must be whole class names there, or one with a usual ending.

An occurrence vector is held as a signature, the sum of a hash of (page, count) over the pages, so that tasks
combine them and no host's pages are ever gathered. Templates are sent to all tasks up to ``SENT_TOKENS`` tokens,
beyond that joined by a shuffle.

Defined results: null, empty or text-free html gives an empty text; a null url has the host ""; a host without a
template (fewer than ``LEAST_PAGES`` pages, or copies of one page) has its slots told by their labels alone;
elements below the depth ``DEEPEST`` are siblings; unclosed and stray tags are tolerated; a quote that is never
closed ends with its tag; an unfinished tag at the end is dropped; repeated rows get repeated results; other
columns are never read.
"""

from __future__ import annotations

import html
import re
from bisect import bisect
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import common

LEAST_TOKENS, LEAST_PAGES, LEAST_SHARE = 2, 3, 100
#: Template tokens that are sent to all tasks at most; more are joined by a shuffle.
SENT_TOKENS = 2_000_000
#: Entries that a task holds before it passes them on.
HELD = 200_000
DEEPEST = 256
MASK = (1 << 64) - 1

#: A start or end tag up to its bracket, quoted values in one piece; and one that minds no quotes.
TAG = re.compile(r"""<(/?)([a-z][a-z0-9:-]*+)([^>"']*+(?:(?:"[^"]*+"|'[^']*+')[^>"']*+)*+)>""", re.I)
PLAIN_TAG = re.compile("<(/?)([a-z][a-z0-9:-]*+)([^>]*+)>", re.I)
#: Elements whose text is no markup.
RAW = {name: re.compile(rf"</{name}\s*>", re.I) for name in "script style noscript template textarea iframe svg".split()}
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
WORD = re.compile("[a-z0-9]+")

#: Elements by their part in the page.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - set("body dd dt html legend summary tbody td tfoot th thead tr".split())
CLOSES_ITSELF, LISTS = set("li dd dt tr td th option".split()), set("ul ol dl table select".split())
OUTSIDE = set("head title nav aside footer form button select option dialog menu".split())
MAIN = {"article", "main"}
#: Words of a class, id or role that mark what is not content.
FURNITURE = set("""ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs
    sidebar aside widget footer header masthead cookie cookies consent gdpr notice popup modal overlay alert comment comments disqus reply replies share sharing social
    related recommended newsletter subscribe subscription signup login pagination pager toolbar contentinfo complementary search form""".split())  # fmt: skip
#: Those that mark it in an article, and the endings they may have there.
IN_ARTICLE = FURNITURE - set("banner footer header masthead alert search form".split())
ENDINGS = set("area bar block box buttons container form item items left links list right section slot thread unit wrapper".split())


def host(url: str | None) -> str:
    found = re.match(r"\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "", re.I)
    return found[1].lower() if found else ""


def labelled(names: list[str], main: bool) -> bool:
    """Whether class, id or role names mark furniture; in an article they must be whole names."""
    for name in names:
        words = WORD.findall(name)
        if not main:
            if not FURNITURE.isdisjoint(words):
                return True
        elif words and words[0] in IN_ARTICLE and all(w in ENDINGS or w in IN_ARTICLE or w.isdigit() for w in words[1:]):
            return True
    return False


def pieces(source: str) -> Iterator[tuple[str, str | None, str, str]]:
    """(text, slash, name, attributes): a page's text up to each tag, with that tag in lower case; the last has none (slash is None). Linear in the page, whatever it holds."""
    at = start = 0
    size, tag = len(source), TAG
    text: list[str] = []
    while True:
        found = source.find("<", start)
        if found < 0 or found + 1 >= size:
            break
        mark = source[found + 1]
        if mark in "!?":
            text.append(source[at:found])
            end = source.find("-->", found + 4) + 3 if source.startswith("<!--", found) else source.find(">", found) + 1
            at = start = size if end < 3 else end
            continue
        if not (mark.isascii() and mark.isalpha()) and not (mark == "/" and found + 2 < size and source[found + 2].isascii() and source[found + 2].isalpha()):
            start = found + 1
            continue
        m = tag.match(source, found)
        if m is None and tag is TAG:
            # a quote or bracket that is open to the end: from here on brackets alone count
            tag = PLAIN_TAG
            m = tag.match(source, found)
        if m is None:
            # no bracket is left; the last unfinished tag goes
            last = source.rfind("<")
            size = last if re.match("</?[a-z]", source[last : last + 3], re.I) else size
            break
        text.append(source[at:found])
        name = m[2].lower()
        at = start = m.end()
        if name in RAW and not m[1]:
            close = RAW[name].search(source, at) if not m[3].endswith("/") or name != "svg" else None
            if close or not m[3].endswith("/"):
                at = start = close.end() if close else size
            continue
        yield "".join(text), m[1], name, m[3]
        text = []
    yield "".join(text) + source[at:size], None, "", ""


class Page:
    """A walk over a page's tokens. ``template`` has the token keys of the host's template; None: the host has none."""

    def __init__(self, source: str, template: set[int] | None = None) -> None:
        self.source, self.template = source, template
        #: (name, place, inside: within something that is not content, main: within an article)
        self.stack: list[tuple[str, str, bool, bool]] = [("", "", False, False)]
        self.open: Counter[str] = Counter()

    def _cut(self, k: int) -> None:
        for name, *_ in self.stack[k:]:
            self.open[name] -= 1
        del self.stack[k:]

    def walk(self) -> Iterator[tuple[str, str, bool, bool, str]]:
        """(kind, place, inside, main, content): kind is tag, block (a tag that bounds a block) or text."""
        stack, template = self.stack, self.template
        for text, slash, name, attributes in pieces(self.source):
            if text:
                _, place, inside, main = stack[-1]
                yield "text", place, inside, main, text
            if slash is None:
                return
            kind = "block" if name in BLOCK else "tag"
            if slash:
                if self.open[name] > 0:
                    k = next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == name)
                    place = stack[k][1]
                    self._cut(k)
                    yield kind, place + "/", stack[-1][2], stack[-1][3], ""
                continue
            if name in CLOSES_P:
                self.close("p", stops=BLOCK - {"p"})
            elif name in CLOSES_ITSELF:
                self.close(name, stops=LISTS)
            names = " ".join(a or b or c for a, b, c in NAMED.findall(attributes)).lower().split() if attributes else []
            _, place, inside, main = stack[-1]
            place = f"{place}/{name}" + "".join(f".{w}" for n in names for w in WORD.findall(n))
            if name == "br":
                yield "text", place, inside, main, " "
                continue
            if name not in VOID:
                if not inside:
                    inside = name in OUTSIDE or (name == "header" and not main)
                    if not inside and names and name not in MAIN and name not in ("html", "body") and labelled(names, main):
                        inside = template is None or token_key(place) in template
                    main = main or (not inside and (name in MAIN or "articlebody" in names))
                if len(stack) < DEEPEST:
                    stack.append((name, place, inside, main))
                    self.open[name] += 1
            yield kind, place, inside, main, ""

    def close(self, name: str, stops: set[str]) -> None:
        if self.open[name] <= 0:
            return
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k][0] == name:
                self._cut(k)
                return
            if self.stack[k][0] in stops:
                return


def token_key(place: str, content: str | None = None) -> int:
    """A signed 64-bit name of a tag at a place (even), or of a text node with that content (odd)."""
    if content is None:
        return int.from_bytes(xxhash.xxh64_digest(place), "big", signed=True) & ~1
    return int.from_bytes(xxhash.xxh64_digest(f"{place}\0{' '.join(content.split())}"), "big", signed=True) | 1


def occurrences(source: str | None) -> dict[int, int]:
    """How often each token occurs on a page, in the order of their first occurrences; text in an article is left out, as it is content there."""
    found: dict[int, int] = {}
    for kind, place, inside, main, content in Page(source or "").walk():
        if kind == "text" and ((main and not inside) or not content.strip()):
            continue
        key = token_key(place, content if kind == "text" else None)
        found[key] = found.get(key, 0) + 1
    return found


def _host_column(url: str) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def candidates(pages: DataFrame, url: str = "url", source: str = "html") -> DataFrame:
    """(host, sign, pages, token): the tokens of each host's candidate classes; ``sign`` names the class within its host."""
    common.small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list[int]] = {}

        def flush() -> pa.RecordBatch:
            rows = list(held.items())
            held.clear()
            of = lambda i: pa.array([v[i] for _, v in rows], pa.int64())
            signs = pa.array(np.array([v[1] & MASK for _, v in rows], np.uint64).view(np.int64))
            return pa.RecordBatch.from_arrays([pa.array([h for (h, _), _ in rows], pa.string()), pa.array([t for (_, t), _ in rows], pa.int64()), of(0), signs, of(2), of(3)], names=["host", "token", "pages", "sign", "low", "high"])

        for batch, texts in common.slices(batches, "__text"):
            for name, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                page = xxhash.xxh64_intdigest(text or "")
                own = int.from_bytes(page.to_bytes(8, "big"), "big", signed=True) if page < 1 << 63 else page - (1 << 64)
                signs: dict[int, int] = {}
                for token, n in (occurrences(text) | {0: 1}).items():
                    if n not in signs:
                        signs[n] = xxhash.xxh64_intdigest(n.to_bytes(4, "big"), page)
                    entry = held.get((name, token))
                    if entry is None:
                        held[name, token] = [1, signs[n], own, own]
                    else:
                        entry[0] += 1
                        entry[1] += signs[n]
                        if own < entry[2]:
                            entry[2] = own
                        elif own > entry[3]:
                            entry[3] = own
                if len(held) > HELD:
                    yield flush()
        if held:
            yield flush()

    seen = pages.select(_host_column(url).alias("host"), F.col(source).alias("__text"))
    each = seen.mapInArrow(run, "host string, token long, pages long, sign long, low long, high long")
    # sums modulo 2^64, in halves so that no addition overflows
    half = 0xFFFFFFFF
    low, high = F.sum(F.col("sign").bitwiseAND(half)), F.sum(F.shiftrightunsigned("sign", 32))
    sums = each.groupBy("host", "token").agg(F.sum("pages").alias("pages"), low.alias("l"), high.alias("h"), F.min("low").alias("low"), F.max("high").alias("high"))
    sign = F.xxhash64((F.col("h") + F.shiftright("l", 32)).bitwiseAND(half), F.col("l").bitwiseAND(half))
    tokens = sums.select("host", "token", "pages", sign.alias("sign"), "low", "high")
    tokens = common.materialise(tokens.where((F.col("pages") >= LEAST_PAGES) & (F.col("low") != F.col("high"))), "tokens")
    sizes = tokens.where("token = 0").select("host", F.col("pages").alias("total"))
    # on a share of a host's pages or more: no more tokens than LEAST_SHARE times those of a page
    often = tokens.where("token <> 0").join(sizes, "host").where(F.col("pages") * LEAST_SHARE >= F.col("total"))
    tags = F.count_if(F.col("token").bitwiseAND(1) == 0)
    classes = often.groupBy("host", "pages", "sign").agg(F.count("*").alias("n"), tags.alias("tags"), F.max("total").alias("total"))
    valid = classes.where((F.col("n") >= LEAST_TOKENS) & (F.col("tags") >= F.when(F.col("pages") * 2 >= F.col("total"), 1).otherwise(2)))
    return common.materialise(often.join(valid.select("host", "pages", "sign"), ["host", "pages", "sign"]).select("host", "sign", "pages", "token"), "candidates")


def standing(source: str | None, classes: dict[int, int], main: int) -> Iterator[tuple[int, int, int]]:
    """(token, slot, place) of a page's template tokens: the slot of the main class it stands in, and its place within its class, by first occurrences."""
    order = [t for t in occurrences(source) if t in classes]
    cuts = [i for i, t in enumerate(order) if classes[t] == main]
    places: Counter[int] = Counter()
    for i, t in enumerate(order):
        own = classes[t]
        yield t, (bisect(cuts, i) if own != main else 0), places[own]
        places[own] += 1


def templates(pages: DataFrame, url: str = "url", source: str = "html") -> DataFrame:
    """(host, token, sign, slot, place): each host's template. ``slot`` is that of the main class in which the token's class, or its part there, is nested."""
    found = candidates(pages, url, source)
    root = found.groupBy("host", "pages", "sign").agg(F.count("*").alias("n")).groupBy("host").agg(F.max(F.struct("pages", "n", "sign"))["sign"].alias("main"))
    classes = common.materialise(found.join(root, "host").select("host", "token", "sign", "main"), "classes")

    def run(batches: Iterator[pa.RecordBatch], known) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list[int]] = {}

        def flush() -> pa.RecordBatch:
            rows = list(held.items())
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([h for (h, _), _ in rows], pa.string()), *[pa.array(x, pa.int64()) for x in ([t for (_, t), _ in rows], *([v[i] for _, v in rows] for i in range(4)))]], names=["host", "token", "s0", "s1", "p0", "p1"])

        for name, text, own in known(batches):
            if own is None:
                continue
            for token, slot, place in standing(text, *own):
                entry = held.setdefault((name, token), [slot, slot, place, place])
                entry[0], entry[1], entry[2], entry[3] = min(entry[0], slot), max(entry[1], slot), min(entry[2], place), max(entry[3], place)
            if len(held) > HELD:
                yield flush()
        if held:
            yield flush()

    made = lambda rows: ({r["token"]: r["sign"] for r in rows}, rows[0]["main"])
    seen = _with_host(pages.select(_host_column(url).alias("host"), F.col(source).alias("__text")), classes, ["sign", "main"], made, run, "host string, token long, s0 long, s1 long, p0 long, p1 long")
    steady = seen.groupBy("host", "token").agg(F.min("s0").alias("slot"), F.max("s1").alias("s1"), F.min("p0").alias("place"), F.max("p1").alias("p1")).where("slot = s1 AND place = p1")
    return common.materialise(classes.join(steady, ["host", "token"]).select("host", "token", "sign", "slot", "place"), "templates")


def _with_host(rows: DataFrame, known: DataFrame, columns: list[str], made, run, schema: str) -> DataFrame:
    """``run(batches, reader)`` over ``rows`` (host, __text, ...): the reader gives (host, text, made(the host's rows of ``known``) or None, *other columns) one by one."""
    spark = rows.sparkSession
    n = known.agg(F.count("*")).first()[0]
    few = n <= SENT_TOKENS
    if few:
        by_host: dict[str, list] = {}
        for r in known.select("host", "token", *columns).collect():
            by_host.setdefault(r.host, []).append(r.asDict())
        sent = spark.sparkContext.broadcast({h: made(own) for h, own in by_host.items()})
    else:
        sent = None
        entry = F.collect_list(F.struct("token", *columns)).alias("__known")
        rows = rows.join(known.groupBy("host").agg(entry), "host", "left").select(*rows.columns, "__known")

    width = len(rows.columns) - (not few)

    def reader(batches: Iterator[pa.RecordBatch]):
        last, own = None, None
        for batch, texts in common.slices(batches, "__text"):
            names = batch.column(0).to_pylist()
            others = [batch.column(i).to_pylist() for i in range(2, width)]
            for i, (name, text) in enumerate(zip(names, texts, strict=True)):
                if few:
                    own = sent.value.get(name)
                elif name != last:
                    held = batch.column(width)[i].as_py()
                    last, own = name, made(held) if held else None
                yield name, text, own, *(x[i] for x in others)

    return rows.mapInArrow(lambda batches: run(batches, reader), schema)


def main_text(source: str | None, template: set[int] | None) -> str:
    """The main text of a page: its content slots, block by block."""
    blocks: list[list[str]] = [[]]
    own = False
    for kind, place, inside, main, content in Page(source or "", template).walk():
        if kind == "text":
            if inside:
                continue
            blocks[-1].append(content)
            own = own or (content.strip() != "" and (main or not template or token_key(place, content) not in template))
        elif kind == "block":
            if not own:
                blocks[-1].clear()
            blocks.append([])
            own = False
    if not own:
        blocks[-1].clear()
    lines = (" ".join("".join(html.unescape(x) for x in block).split()) for block in blocks)
    return "\n".join(x for x in lines if x)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """Per page: key, url, text."""
    found = templates(pages, url, source)
    names = [key, "url", "text"]
    kind = pages.schema[key].dataType
    keys = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch], known) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in held], keys), pa.array([r[1] for r in held], pa.string()), pa.array([r[2] for r in held], pa.string())], names=names)

        for _, text, template, own, where in known(batches):
            held.append((own, where, main_text(text, template)))
            size += len(held[-1][2])
            if len(held) >= common.BATCH_ROWS or size > common.SLICE_CHARS:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    rows = pages.select(_host_column(url).alias("host"), F.col(source).alias("__text"), F.col(key).alias("__key"), F.col(url).alias("__url"))
    return _with_host(rows, found, [], lambda own: frozenset(r["token"] for r in own), run, f"`{key}` {kind.simpleString()}, url string, text string")


def lengths(extracted: DataFrame, key: str = "page_id") -> DataFrame:
    return extracted.select(key, "url", "text", F.char_length("text").cast("long").alias("n_chars"))
