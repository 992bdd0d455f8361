"""Surrogates for personal data: detected entities receive keyed, type-consistent replacements.

Entities: e-mail addresses, payment card numbers (Luhn), IBANs (mod 97), IPv4 and IPv6 addresses, phone
numbers, US social security numbers, and personal names after a form of address or a known given name. A name
is several entities, its given names and its surnames, so that a surname alone corefers with the full name;
wherever a part of a name that was found in a text stands alone in that text, capitalised, it is a mention of
that name and gets its surrogate too.

A surrogate follows from the key, the kind, the entity's canonical form and an attempt number: the same
entity gets the same surrogate everywhere, in the surface's own format (separators, case, country code,
issuer digit, check digits, length), script, and for given names gender. Distinctness is checked over the
whole corpus: entities whose surrogates coincide, or whose surrogate is an entity of the corpus itself, go to
their next attempt until none is left; the least settled one keeps its surrogate. Only the few entities beyond
their first attempt are an exception that rewriting must look up. It ends: from attempt ``GROW`` on every
attempt makes the surrogate one character longer, at the cost of its exact length, so each round has at least
ten times the room of the one before and the entities that still collide die out.

Defined results: null text stays null, without entities; text without entities is unchanged; where matches
of different kinds overlap the earlier, then the longer, then the kind listed first wins; repeated rows get
repeated results; other columns are kept as they are.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window, functions as F, types as T

from . import common

#: Kinds in listed order.
KINDS = ("email", "card", "iban", "ip", "phone", "ssn", "name")
#: Exceptions that are sent to every task at most; more are joined by the text's digest.
SENT = 10_000
#: Distinct entities that a task holds before it passes them on.
HELD = 100_000
#: The attempt from which surrogates grow.
GROW = 4

#: Top-level parts whose ``example`` domains are reserved.
RESERVED = ("com", "net", "org")
#: Forms of address by gender.
ADDRESS = {
    "m": "Mr Mister Herr Herrn Señor Sr Don Monsieur Signor Signore Г-н г-н Господин господин",
    "f": "Mrs Ms Miss Frau Señora Señorita Sra Srta Doña Madame Mademoiselle Mme Mlle Signora Signorina Г-жа г-жа Госпожа госпожа",
    "u": "Dr Prof Professor Mx",
}
#: Given names by script and gender; they are known names, and the first surrogates.
GIVEN = {
    ("Latin", "m"): "James John Robert Michael William David Richard Thomas Charles Daniel Matthew Anthony Peter Paul Hans Karl Jürgen Klaus Stefan Andreas Pierre Jacques Michel François Carlos José Miguel Antonio Javier Fernando",
    ("Latin", "f"): "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Margaret Anna Ursula Monika Petra Sabine Claudia Katharina Marie Nathalie Isabelle Sylvie Françoise Carmen María Dolores Pilar Teresa Lucía",
    ("Cyrillic", "m"): "Александр Дмитрий Сергей Андрей Алексей Михаил Иван Николай Владимир Павел",
    ("Cyrillic", "f"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана Екатерина Юлия",
}
GENDER = {name: gender for (_, gender), names in GIVEN.items() for name in names.split()}
#: Syllables for names of each script, and the endings of given names by gender.
SYLLABLES = {
    "Latin": "ba be bi bo bu da de di do du fa fe fi fo ga ge go ha he hi ho ka ke ki ko ku la le li lo lu ma me mi mo mu na ne ni no pa pe pi po ra re ri ro ru sa se si so ta te ti to tu va ve vi vo wa we wi za ze zi zo",
    "Cyrillic": "ба бе би бо да де ди до га го ка ке ки ко ла ле ли ло ма ме ми мо на не ни но па пе по ра ре ри ро са се си со та те ти то ва ве ви во за зо",
    "Greek": "βα βε βο γα γε δα δε δο κα κε κι κο λα λε λι μα με μι να νε νι νο πα πε πο ρα ρε ρι ρο σα σε σι σο τα τε τι το φα φι",
}
ENDINGS = {("Latin", "m"): "n", ("Latin", "f"): "na", ("Latin", "u"): "l", ("Cyrillic", "m"): "н", ("Cyrillic", "f"): "на", ("Greek", "m"): "ς", ("Greek", "f"): "α"}
#: Ranges of letters by script, for what has no syllables.
ALPHABETS = {"Latin": ("a", 26), "Cyrillic": ("а", 32), "Greek": ("α", 17), "Hebrew": ("א", 27), "Arabic": ("ب", 19), "Hiragana": ("か", 30), "Katakana": ("カ", 30), "Han": ("一", 2000), "Hangul": ("가", 2000), "Devanagari": ("क", 33)}

SEP = r"[%$&#*!]{0,3}[ .\-]?"
EMAIL_LEFT = regex.compile(r"(?r)[\w.+%-]++")
EMAIL_RIGHT = regex.compile(r"(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}(?![A-Za-z0-9-])")
NUMBERS = {
    "card": re.compile(r"(?<![\w.])[2-6]\d{3}[ -]?\d{4}[ -]?\d{4}[ -]?\d{1,7}(?![\w]|[ -]?\d)|(?<![\w.])3\d{3}[ -]?\d{6}[ -]?\d{5}(?!\w)"),
    "iban": re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"),
    "ip": re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\w|\.\d)"),
    "phone": re.compile(rf"(?<![\w+])(?:\+\d{{1,3}}{SEP}(?:\(\d{{1,4}}\)|\d{{1,4}})(?:{SEP}\d{{2,4}}){{2,4}}|\(\d{{3}}\){SEP}\d{{3}}{SEP}\d{{4}}|\d{{3}}([ .-])\d{{3}}\1\d{{4}})(?![\w-]|[ .]\d)"),
    "ssn": re.compile(r"(?<![\w-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\w-])"),
}
IPV6 = re.compile(r"(?<![\w:.])(?=[0-9A-Fa-f]{0,4}:)[0-9A-Fa-f:]{2,39}(?![\w:]|\.\d)")
_word = r"\p{Lu}(?:[\p{Ll}\p{Mn}]+|[\p{Lu}\p{Mn}]+)(?:[-'’]\p{Lu}\p{L}+)*"
_forms = {form: gender for gender, forms in ADDRESS.items() for form in forms.split()}
_forms |= {form.upper(): gender for form, gender in _forms.items()}
_known = sorted({*GENDER, *(name.upper() for name in GENDER)})
NAME = regex.compile(rf"(?<![\w])(?:(?P<form>{'|'.join(sorted(_forms, key=len, reverse=True))})\.?[  ](?P<after>{_word}(?:[ ]{_word}){{0,2}})|(?P<known>{'|'.join(_known)})(?:[ ]{_word}){{1,2}})(?!\w)")
#: A word that may be a mention of a name.
MENTION = regex.compile(rf"(?<![\w]){_word}(?!\w)")
_gender = GENDER | {name.upper(): gender for name, gender in GENDER.items()}


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def iban_holds(text: str) -> bool:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def ipv6_holds(text: str) -> bool:
    """Whether it is an IPv6 address of three groups at least."""
    try:
        return len(text.replace(":", "")) >= 3 and text.count(":") >= 3 and ipaddress.ip_address(text).version == 6
    except ValueError:
        return False


def digits_of(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def detect(text: str | None) -> list[tuple[int, int, str, tuple[tuple[int, int, str, str], ...]]]:
    """(start, end, kind, parts) in order, without overlaps; a part is (start, end, entity kind, canonical form)."""
    if not text:
        return []
    found = []
    at = text.find("@")
    while at >= 0:
        left, right = EMAIL_LEFT.match(text, 0, at), EMAIL_RIGHT.match(text, at + 1)
        if left and right:
            start = left.start() + len(left[0]) - len(left[0].lstrip("."))
            if start < at:
                found.append((start, right.end(), "email", None))
        at = text.find("@", at + 1)
    data = text.encode("utf-8", "surrogatepass")
    if len(data.translate(None, b"0123456789")) < len(data):
        for kind, pattern in NUMBERS.items():
            for m in pattern.finditer(text):
                plain = digits_of(m[0])
                if kind == "card" and not (13 <= len(plain) <= 19 and luhn(plain)):
                    continue
                if kind == "iban" and not iban_holds(m[0].replace(" ", "")):
                    continue
                if kind == "phone" and not 7 <= len(plain) <= 15:
                    continue
                found.append((m.start(), m.end(), kind, None))
    if "::" in text or text.count(":") > 6:
        found += [(m.start(), m.end(), "ip", None) for m in IPV6.finditer(text) if ipv6_holds(m[0])]
    named = False
    for m in NAME.finditer(text):
        start, end = (m.start("after"), m.end()) if m["form"] else (m.start(), m.end())
        found.append((start, end, "name", _forms.get(m["form"]) if m["form"] else _gender[m["known"]]))
        named = True
    found.sort(key=lambda x: (x[0], -x[1], KINDS.index(x[2])))
    out, done = [], 0
    for start, end, kind, gender in found:
        if start < done:
            continue
        done = end
        out.append((start, end, kind, tuple(_parts(text, start, end, kind, gender))))
    return _with_mentions(text, out) if named else out


def _with_mentions(text: str, found: list) -> list:
    """``found`` with the words that stand alone and are part of a name found in the text; the first name that has the word tells its kind."""
    kinds: dict[str, str] = {}
    for *_, kind, parts in found:
        if kind == "name":
            for *_, own, canonical in parts:
                kinds.setdefault(canonical, own)
    out, k = [], 0
    for m in MENTION.finditer(text):
        own = kinds.get(m[0].casefold())
        if own is None:
            continue
        while k < len(found) and found[k][1] <= m.start():
            out.append(found[k])
            k += 1
        if k == len(found) or m.end() <= found[k][0]:
            out.append((m.start(), m.end(), "name", ((m.start(), m.end(), own, m[0].casefold()),)))
    return out + found[k:]


def _parts(text: str, start: int, end: int, kind: str, gender: str | None) -> Iterator[tuple[int, int, str, str]]:
    whole = text[start:end]
    if kind == "email":
        yield start, end, kind, whole.lower()
    elif kind in ("card", "phone", "ssn"):
        country = re.match(r"\+\d{1,3}", whole)
        yield start, end, kind, digits_of(country[0]) + "+" + digits_of(whole[country.end() :]) if country else digits_of(whole)
    elif kind == "iban":
        yield start, end, kind, whole.replace(" ", "")
    elif kind == "ip":
        yield start, end, kind, whole.lower()
    else:
        words = list(re.finditer(r"\S+", whole))
        for i, w in enumerate(words):
            given = i < len(words) - 1
            own = _gender.get(w[0], gender) if given else None
            yield start + w.start(), start + w.end(), f"given_{own}" if given else "surname", w[0].casefold()


class Choices:
    """Numbers that follow from a key and a message."""

    def __init__(self, key: bytes, message: str) -> None:
        self.key, self.message, self.n, self.pool = key, message.encode("utf-8", "surrogatepass"), 0, b""

    def below(self, most: int) -> int:
        if len(self.pool) < 8:
            self.pool += hmac.digest(self.key, self.message + self.n.to_bytes(4, "big"), hashlib.sha256)
            self.n += 1
        value, self.pool = int.from_bytes(self.pool[:8], "big"), self.pool[8:]
        return value % most


def script(word: str) -> str:
    for name in ALPHABETS:
        if regex.search(rf"\p{{{name}}}", word):
            return name
    return "Latin"


def surrogate(key: bytes, kind: str, canonical: str, attempt: int = 0) -> str:
    """The canonical form of an entity's replacement; never that of the entity itself."""
    while True:
        out = _surrogate(Choices(key, f"{kind}\0{canonical}\0{attempt}"), kind, canonical, attempt)
        if out != canonical:
            return out
        key = hashlib.sha256(key).digest()


def _shape(pick: Choices, text: str) -> str:
    out = []
    for c in text:
        if c.isdigit():
            out.append(str(pick.below(10)))
        elif c.isalpha():
            first, n = ALPHABETS[script(c)]
            out.append(chr(ord(first) + pick.below(n)))
        else:
            out.append(c)
    return "".join(out)


def _more(pick: Choices, attempt: int, characters: str = "0123456789") -> str:
    """What makes a surrogate of a late attempt longer."""
    return "".join(characters[pick.below(len(characters))] for _ in range(attempt - GROW + 1))


def _surrogate(pick: Choices, kind: str, canonical: str, attempt: int) -> str:
    if kind == "email":
        local, _, domain = canonical.rpartition("@")
        rest, _, top = domain.rpartition(".")
        rest = rest.removesuffix("example").rstrip(".") or "mail"
        return f"{_shape(pick, local)}{_more(pick, attempt)}@{_shape(pick, rest)}.example.{top if top in RESERVED else RESERVED[pick.below(3)]}"
    if kind == "card":
        body = canonical[0] + "".join(str(pick.below(10)) for _ in canonical[2:]) + _more(pick, attempt)
        return next(body + str(d) for d in range(10) if luhn(body + str(d)))
    if kind == "iban":
        body = "".join(str(pick.below(10)) if c.isdigit() else chr(65 + pick.below(26)) for c in canonical[4:]) + _more(pick, attempt)
        check = 98 - int("".join(str(int(c, 36)) for c in body + canonical[:2] + "00")) % 97
        return f"{canonical[:2]}{check:02d}{body}"
    if kind == "ip":
        if ":" in canonical or attempt >= GROW:
            # the documentation range; its 96 bits are room enough for any corpus
            return ":".join(["2001", "db8", *(f"{pick.below(1 << 16):x}" for _ in range(6))])
        return ".".join(str((1 if i == 0 else 0) + pick.below(223 if i == 0 else 255)) for i in range(4))
    if kind == "phone":
        country, plus, rest = canonical.rpartition("+")
        return country + plus + "".join(str(2 + pick.below(8)) if i == 0 else str(pick.below(10)) for i in range(len(rest))) + _more(pick, attempt)
    if kind == "ssn":
        area = 1 + pick.below(898)
        return f"{area + (area >= 666):03d}{1 + pick.below(99):02d}{1 + pick.below(9999):04d}{_more(pick, attempt)}"
    own = script(canonical)
    gender = kind.removeprefix("given_") if kind != "surname" else ""
    names = GIVEN.get((own, gender), "").split()
    if names and attempt < 2:
        return names[pick.below(len(names))].casefold()
    if own not in SYLLABLES:
        first, n = ALPHABETS[own]
        return _shape(pick, canonical) + "".join(chr(ord(first) + pick.below(n)) for _ in range(attempt - GROW + 1))
    syllables = SYLLABLES[own].split()
    word = "".join(syllables[pick.below(len(syllables))] for _ in range(3 + max(0, attempt - GROW + 1)))
    if gender:
        return word + ENDINGS.get((own, gender), "")
    return word + next((e for e in ("ова", "ева", "ин", "ов", "ев") if own == "Cyrillic" and canonical.endswith(e)), "")


def rendered(surface: str, kind: str, canonical: str) -> str:
    """A canonical surrogate in the format of the surface that it replaces; what is longer than it stands at its end."""
    if kind in ("card", "phone", "ssn"):
        digits = iter(canonical.replace("+", ""))
        return "".join([next(digits) if c in "0123456789" else c for c in surface]) + "".join(digits)
    if kind == "iban":
        chars = iter(canonical)
        return "".join([c if c == " " else next(chars) for c in surface]) + "".join(chars)
    if kind == "ip":
        return canonical
    if surface.isupper() and len(surface) > 1:
        return canonical.upper()
    if kind == "email":
        return canonical
    return canonical[:1].upper() + canonical[1:]


def replace(text: str | None, key: bytes, attempts: dict[tuple[str, str], int]) -> tuple[str | None, dict[str, int]]:
    """The text with surrogates, and the number of entities of each kind; ``attempts`` has those beyond their first."""
    spans = detect(text)
    if not spans:
        return text, {}
    out, at, counts = [], 0, {}
    for _, _, kind, parts in spans:
        counts[kind] = counts.get(kind, 0) + 1
        for start, end, own, canonical in parts:
            out += (text[at:start], rendered(text[start:end], own, surrogate(key, own, canonical, attempts.get((own, canonical), 0))))
            at = end
    return "".join(out) + text[at:], counts


def entities(docs: DataFrame, text: str = "text") -> DataFrame:
    """The distinct (kind, canonical) of all texts."""
    common.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: set[tuple[str, str]] = set()

        def flush() -> pa.RecordBatch:
            rows = list(held)
            held.clear()
            return pa.RecordBatch.from_pydict({"kind": pa.array([k for k, _ in rows], pa.string()), "canonical": pa.array([c for _, c in rows], pa.string())})

        for _, texts in common.slices(batches, "__text"):
            held.update((kind, canonical) for t in texts for *_, parts in detect(t) for _, _, kind, canonical in parts)
            if len(held) > HELD:
                yield flush()
        if held:
            yield flush()

    return docs.select(F.col(text).alias("__text")).mapInArrow(run, "kind string, canonical string").distinct()


def settle(found: DataFrame, key: bytes) -> DataFrame:
    """(kind, canonical, attempt, surrogate) of the distinct entities ``found``: surrogates are distinct within a kind and no entity's own."""

    @F.pandas_udf(T.StringType())
    def made(kind, canonical, attempt):
        return kind.combine(canonical, lambda k, c: (k, c)).combine(attempt, lambda x, a: surrogate(key, x[0], x[1], int(a)))

    named = lambda df: df.withColumn("surrogate", made("kind", "canonical", "attempt"))
    # given names of any gender share their surrogates' space, as a name is seen without its gender
    space = F.when(F.col("kind").startswith("given"), "given").otherwise(F.col("kind"))
    known = common.materialise(found.select("kind", "canonical"), "entities")
    own = known.select(space.alias("space"), F.col("canonical").alias("surrogate")).distinct()
    now = common.materialise(named(known.withColumn("attempt", F.lit(0))), "surrogates")
    while True:
        order = Window.partitionBy("space", "surrogate").orderBy("attempt", "canonical", "kind")
        spaced = now.withColumn("space", space)
        later = spaced.withColumn("place", F.row_number().over(order)).where("place > 1").select("kind", "canonical")
        taken = spaced.join(own, ["space", "surrogate"], "left_semi").select("kind", "canonical")
        losers = common.materialise(later.union(taken).distinct(), "collisions")
        if losers.isEmpty():
            return now
        moved = named(now.join(losers, ["kind", "canonical"], "left_semi").select("kind", "canonical", (F.col("attempt") + 1).alias("attempt")))
        new = common.materialise(now.join(losers, ["kind", "canonical"], "left_anti").unionByName(moved), "surrogates")
        common.remove(now)
        now = new


def pseudonymise(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with surrogates in ``text``, and ``entities`` map<string,int>: their number by kind."""
    spark = docs.sparkSession
    settled = settle(entities(docs, text), key)
    late = settled.where("attempt > 0").select("kind", "canonical", "attempt")
    few = late.count() <= SENT
    sent = spark.sparkContext.broadcast({(r.kind, r.canonical): r.attempt for r in late.collect()} if few else {})
    rows = docs if few else _with_exceptions(docs, late, text)
    schema = T.StructType([*docs.schema.fields, T.StructField("entities", T.MapType(T.StringType(), T.IntegerType()))])
    kept = [f.name for f in docs.schema]
    at, names = kept.index(text), [*kept, "entities"]
    extra = [F.lit(None).cast("array<struct<kind:string,canonical:string,attempt:int>>").alias("__late")] if few else ["__late"]
    rows = rows.select(*[F.col(f"`{c}`") for c in kept if c != text], *extra, F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in common.slices(batches, "__text"):
            own = batch.column(len(kept) - 1).to_pylist()
            done = [replace(t, key, {(x["kind"], x["canonical"]): x["attempt"] for x in late} if late else sent.value) for t, late in zip(texts, own, strict=True)]
            columns = batch.columns[: len(kept) - 1]
            columns.insert(at, pa.array([t for t, _ in done], pa.string()))
            counts = pa.array([None if t is None else list(n.items()) for t, n in done], pa.map_(pa.string(), pa.int32()))
            yield pa.RecordBatch.from_arrays([*columns, counts], names=names)

    return rows.mapInArrow(run, schema)


def _with_exceptions(docs: DataFrame, late: DataFrame, text: str) -> DataFrame:
    """``docs`` with ``__late``: the exceptions among each text's entities, found by the text's digest."""
    digest = F.sha2(F.col(text), 256)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in common.slices(batches, "__text"):
            rows = [(d, kind, c) for d, t in zip(batch.column(0).to_pylist(), texts, strict=True) for *_, parts in detect(t) for _, _, kind, c in parts]
            yield pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in rows], pa.string()) for i, n in enumerate(("digest", "kind", "canonical"))})

    of = docs.select(digest.alias("digest"), F.col(text).alias("__text")).mapInArrow(run, "digest string, kind string, canonical string").distinct()
    by_text = of.join(late, ["kind", "canonical"]).groupBy("digest").agg(F.collect_list(F.struct("kind", "canonical", "attempt")).alias("__late"))
    return docs.withColumn("__digest", digest).join(by_text.withColumnRenamed("digest", "__digest"), "__digest", "left").drop("__digest")
