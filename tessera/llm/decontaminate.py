"""Benchmark decontamination by templates, with DataFrame functions only.

A text is canonicalised into a template: numbers (and number words), units after a number, and names
(capitalised words within a sentence) become typed placeholders; other words are lower-cased, and
punctuation goes. Windows of ``WIDTH`` template words are hash-joined with those of the benchmark items. For
documents that share ``SHARE`` of an item's windows the slots are then compared: along one alignment, each
value of the item must stand against one value of the document throughout. Windows of an alignment whose
slots contradict each other do not count. A capitalised word that begins a text, sentence, line or quotation can
be a word or a name, so windows have two readings, each judged by itself: such a word is a word in one and a name
in the other. So a question with other numbers, names or units is still caught,
and one that merely has the same form is not.

Defined results: null or empty texts have no windows; a text shorter than ``WIDTH`` words is a single window,
matched by a text of just those words; windows with fewer than ``LITERALS`` words that are no placeholders
are no evidence of a template, and an item without any other window is looked for by its plain words, numbers and
names included, in windows of the same width and with the same share; a document is its id
with its text, so repeated rows are one result and rows with a null id are told apart by their texts; items
are told apart by their id and text alike; empty tables give no rows; other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import materialise

WIDTH = 5
SHARE = 0.8
LITERALS = 2
#: Benchmark windows with their words (150 bytes or so each), and documents to look at again (32 bytes), that are broadcast at most; more are joined by a shuffle.
BROADCAST_WINDOWS, BROADCAST_ROWS = 200_000, 1_000_000

#: Marks of slots, from the private use area: name, number, unit; what joins the words of one name; and a word that may be a name.
NAME, NUMBER, UNIT, JOINT, START = "", "", "", "", ""
#: Number words and units.
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen half"
UNITS = """km m cm mm mi miles mile meters meter metres metre kilometers kilometres feet foot ft inches inch in yards yard kg g mg lb lbs pounds pound grams gram kilograms kilogram ounces ounce oz
    tons ton l ml liters liter litres litre gallons gallon cups cup s seconds second minutes minute min hours hour hr h days day weeks week months month years year mph kmh km/h m/s
    percent dollars dollar cents cent euros euro usd eur gbp degrees degree c f k w kw kwh v hz khz mhz ghz kb mb gb tb"""


def marked(text: Column) -> Column:
    """A text's words with their slots marked, joined by single spaces."""
    words, units = NUMBER_WORDS.replace(" ", "|"), "|".join(sorted(UNITS.split(), key=len, reverse=True))
    # a capitalised word is a name where a letter, a digit or a comma stands before it
    out = F.regexp_replace(text, r"\p{Lu}(?<=[\p{L}\p{N},;] \p{Lu})\p{Ll}+", f"{NAME}$0")
    out = F.when(F.contains(out, F.lit(NAME)), F.regexp_replace(out, rf" {NAME}(?<={NAME}\p{{L}}{{1,40}} {NAME})", JOINT)).otherwise(out)
    # any other may be one
    out = F.regexp_replace(out, rf"(?<![\p{{L}}\p{{M}}\p{{N}}{NAME}{JOINT}])\p{{Lu}}(?=\p{{Ll}})", f"{START}$0")
    numbers = F.regexp_replace(F.regexp_replace(out, r"(?<=\d)[.,](?=\d)", ""), r"\d+", f"{NUMBER}$0 ")
    numbers = F.regexp_replace(numbers, rf"(?i)({NUMBER}\d+) +({units})(?![\p{{L}}\p{{N}}])", f"$1 {UNIT}$2")
    out = F.when(out.rlike(r"\d"), numbers).otherwise(out)
    out = F.regexp_replace(F.lower(out), rf"(?<![\p{{L}}{NAME}-{JOINT}])(?:{words})(?!\p{{L}})", f"{NUMBER}$0")
    out = F.when(F.contains(out, F.lit(START)), F.regexp_replace(out, rf"{START}(?!\p{{L}})", "")).otherwise(out)
    return F.trim(F.regexp_replace(out, rf"[^\p{{L}}\p{{M}}\p{{N}}{NAME}-{START}]+", " "))


def _read(marked_text: Column, mark: str) -> Column:
    """One reading: ``mark`` for what may be a name, nothing or ``NAME``."""
    return F.replace(marked_text, F.lit(START), F.lit(mark))


def _split(joined: Column) -> Column:
    return F.filter(F.split(joined, " "), lambda w: w != "")


def _placed(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with further columns that are computed once, whatever refers to them."""
    made = F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))
    return df.select("*", F.inline(made))


def windows(df: DataFrame, text: str, raw: bool = False) -> DataFrame:
    """``df`` without ``text``, with ``hashes`` and ``others`` array<long>, the windows' in order in either reading; with ``raw`` also the marked words."""
    rest = [c for c in df.columns if c != text]
    words = df.select(*rest, marked(F.coalesce(F.col(text), F.lit(""))).alias("__marked"))
    words = _placed(words, words=_split(F.col("__marked"))) if raw else words
    rest += ["words"] if raw else []
    template = lambda mark: F.transform(_split(F.regexp_replace(_read(F.col("__marked"), mark), f"([{NAME}-{UNIT}])[^ ]+", "$1")), lambda w: F.xxhash64(w))
    hashed = _placed(words, __h=template(""), __g=template(NAME))
    n = F.greatest(F.size("__h") - (WIDTH - 1), F.least(F.size("__h"), F.lit(1)))
    each = lambda h: F.transform(F.slice(h, F.lit(1), n), lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, WIDTH)]))
    return hashed.select(*rest, each("__h").alias("hashes"), each("__g").alias("others"))


def _plain_windows(df: DataFrame, text: str) -> DataFrame:
    """``df`` without ``text``, with ``hashes`` array<long>: the windows of plain words, nothing canonicalised but their case."""
    rest = [c for c in df.columns if c != text]
    plain = F.regexp_replace(F.translate(marked(F.coalesce(F.col(text), F.lit(""))), JOINT, " "), f"[{NAME}-{START}]", "")
    words = _placed(df.select(*rest, plain.alias("__plain")), __h=F.transform(_split(F.col("__plain")), lambda w: F.xxhash64(w)))
    n = F.greatest(F.size("__h") - (WIDTH - 1), F.least(F.size("__h"), F.lit(1)))
    each = F.transform(F.slice("__h", F.lit(1), n), lambda x, i: F.xxhash64(x, *[F.get("__h", i + k) for k in range(1, WIDTH)]))
    return words.select(*rest, each.alias("hashes"))


def _by_reading(words: str, first: Column, second: Column) -> Column:
    """array<struct<second, hash, words>>: a window in the first reading, and in the second one if it differs; each where its condition holds."""
    one = lambda k, hash, mark, sure: F.struct(F.lit(k).alias("second"), F.col(hash).alias("hash"), F.transform(words, lambda w: _read(w, mark)).alias("words"), sure.alias("sure"))
    return F.filter(F.array(one(False, "hash", "", first), one(True, "other", NAME, second & (F.col("other") != F.col("hash")))), lambda x: x["sure"])


def _item_windows(items: DataFrame) -> DataFrame:
    """(own, j, hash, words, of, readings): the windows of items that are evidence, by reading, how many an item has, and the readings in which they count."""
    found = windows(items.select("own", "text"), "text", raw=True).select("own", "words", F.posexplode(F.arrays_zip("hashes", "others")).alias("j", "c"))
    placed = found.select("own", "j", F.col("c.hashes").alias("hash"), F.col("c.others").alias("other"), F.slice("words", F.col("j") + 1, F.lit(WIDTH)).alias("words"))
    sure = lambda marks: F.size(F.filter("words", lambda w: ~w.rlike(f"^[{marks}]"))) >= F.least(F.lit(LITERALS), F.size("words"))
    placed = placed.withColumns({"same": F.col("hash") == F.col("other"), "w": _by_reading("words", sure(f"{NAME}-{UNIT}"), sure(f"{NAME}-{UNIT}{START}"))})
    each = placed.select("own", "j", "same", F.explode("w").alias("w")).select("own", "j", "w.hash", "w.words", F.col("w.second").alias("second"), "same")
    readings = F.when(F.col("second"), F.array(F.lit(2))).when(F.col("same"), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    # a window that is evidence in the second reading is so in the first
    of = each.where("not second").groupBy("own").agg(F.count("*").alias("of"))
    return each.select("own", "j", "hash", "words", readings.alias("readings")).join(of, "own")


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", share: float = SHARE) -> DataFrame:
    """(key, digest, item_id, windows, of, reparameterised): documents that hold an item, as a template with consistent slots.

    ``digest`` is xxhash64 of the document's text and with the key names the row; ``windows`` is the number
    of the item's windows found, of ``of``; ``reparameterised`` tells whether a slot differs.
    """
    items = benchmark.where(F.col(item_text).isNotNull()).select(F.col(item).alias("item"), F.xxhash64(item_text).alias("own"), F.col(item_text).alias("text")).distinct()
    bench = materialise(_item_windows(items.select("own", "text").distinct()), "benchmark-windows")
    held = F.broadcast if bench.count() <= BROADCAST_WINDOWS else (lambda df: df)
    # a struct, as its null fields are equal to each other
    doc = F.struct(F.col(key).alias("key"), F.xxhash64(text).alias("digest"))
    rows = docs.select(doc.alias("doc"), F.col(text).alias("text"))

    # which documents share enough windows with an item
    shared = windows(rows, "text").select("doc", F.explode(F.array_union("hashes", "others")).alias("hash")).join(held(bench.select("own", "j", "hash", "of")), "hash")
    counted = shared.select("doc", "own", "of", "j").distinct().groupBy("doc", "own", "of").agg(F.count("*").alias("n"))
    likely = materialise(counted.where(F.col("n") >= F.col("of") * share).select("doc").distinct(), "likely")
    # items of placeholders alone, by their plain words
    poor = materialise(_plain_windows(items.select("own", "text").distinct().join(bench.select("own").distinct(), "own", "left_anti"), "text").select("own", F.posexplode("hashes").alias("j", "hash")), "plain-windows")
    sizes = poor.groupBy("own").agg(F.count("*").alias("of"))
    verbatim = None
    if not poor.isEmpty():
        few = F.broadcast if poor.count() <= BROADCAST_WINDOWS else (lambda df: df)
        met = _plain_windows(rows, "text").select("doc", F.explode(F.array_distinct("hashes")).alias("hash")).join(few(poor.join(sizes, "own")), "hash")
        verbatim = met.groupBy("doc", "own", "of").agg(F.count_distinct("j").alias("windows")).where(F.col("windows") >= F.col("of") * share)

    again_held = F.broadcast if likely.count() <= BROADCAST_ROWS else (lambda df: df)

    # their slots
    again = rows.join(again_held(likely), "doc", "left_semi").distinct()
    placed = windows(again, "text", raw=True).select("doc", "words", F.posexplode(F.arrays_zip("hashes", "others")).alias("i", "c"))
    placed = placed.select("doc", "i", F.col("c.hashes").alias("hash"), F.col("c.others").alias("other"), F.slice("words", F.col("i") + 1, F.lit(WIDTH)).alias("words"))
    placed = placed.select("doc", "i", F.explode(_by_reading("words", F.lit(True), F.lit(True))).alias("w")).select("doc", "i", "w.hash", F.col("w.words").alias("theirs"), F.col("w.second").alias("second"))
    along = ["doc", "own", "of", "reading", "shift"]
    hits = placed.join(held(bench), "hash").withColumn("shift", F.col("i") - F.col("j"))
    hits = hits.withColumn("reading", F.explode(F.when(F.col("second"), F.array(F.lit(2))).otherwise(F.col("readings"))))
    hits = materialise(hits.select(*along, "j", "words", "theirs"), "hits")
    slots = F.filter(F.arrays_zip("words", "theirs"), lambda s: s["words"].rlike(f"^[{NAME}-{UNIT}]"))
    values = hits.select(*along, F.explode(slots).alias("s")).select(*along, F.col("s.words").alias("a"), F.col("s.theirs").alias("b")).distinct()
    per_slot = values.groupBy(*along, "a").agg(F.count("*").alias("n"), F.max(F.col("a") != F.col("b")).alias("other"))
    alignments = per_slot.groupBy(*along).agg(F.max("n").alias("most"), F.max("other").alias("other"))
    sure = hits.select(*along, "j").join(alignments, along, "left").where("most IS NULL OR most = 1")
    each = sure.groupBy("doc", "own", "of", "reading", "j").agg(F.min(F.coalesce("other", F.lit(False))).alias("other"))
    found = each.groupBy("doc", "own", "of", "reading").agg(F.count("*").alias("windows"), F.max("other").alias("reparameterised"))
    best = found.where(F.col("windows") >= F.col("of") * share).groupBy("doc", "own", "of").agg(F.min(F.struct("reading", "windows", "reparameterised")).alias("best"))
    best = best.select("doc", "own", "of", "best.windows", "best.reparameterised")
    if verbatim is not None:
        best = best.unionByName(verbatim.withColumn("reparameterised", F.lit(False)))
    named = best.join(items.select("own", "item"), "own")
    return named.select(F.col("doc.key").alias(key), F.col("doc.digest").alias("digest"), F.col("item").alias(item), "windows", "of", "reparameterised")
