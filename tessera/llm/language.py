"""Hierarchical language identification: the family first, then one-versus-one linear SVMs within it.

A text becomes the square roots of the relative frequencies of its character 1-, 2- and 3-grams, hashed
into a fixed number of places; letters are lower-cased and everything else counts as one space. One
linear SVM per family (against the rest) picks the family; within it one SVM per pair of languages votes.

The SVMs are fitted on a bounded sample of labelled rows (``sample_rows``, spread evenly over the
languages and chosen by a hash of the id); only its feature vectors come to the driver. The prediction
uses the whole text and nothing else.

Defined results: null text, or text without a letter: ``und`` with score 0; nothing to learn from: ``und``
with score 0 for all; a single learned language: that language with score 1; rows whose id is null are not
learned from and not held out; repeated rows get repeated results; other columns are never read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from . import common

#: Places of the hashed features.
PLACES = 4096
#: Rows that the SVMs are fitted on, at most (in expectation).
SAMPLE_ROWS = 2000
#: Languages by family (ISO 639 codes); a language not listed is its own family.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fo af fy lb yi",
    "romance": "fr es pt it ro ca gl oc",
    "slavic": "ru uk be bg mk sr hr bs sl cs sk pl",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "celtic": "ga gd cy br",
    "turkic": "tr az kk ky uz tk tt",
    "semitic": "ar he mt am",
    "indic": "hi ur bn mr ne pa gu si",
    "iranian": "fa ps ku tg",
    "dravidian": "ta te kn ml",
    "austronesian": "id ms tl jv",
}
FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs.split()}


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def features(text: str | None) -> np.ndarray | None:
    """The unit vector of a text, None if it has no letter."""
    if not text:
        return None
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    kept = letters()[points]
    if not kept.any():
        return None
    x = np.empty(len(points) + 2, np.uint32)
    x[0] = x[-1] = 32
    x[1:-1] = np.where(kept, points, 32)
    two = x[:-1] * np.uint32(0x9E3779B1) + x[1:] * np.uint32(0x85EBCA6B)
    three = two[:-1] * np.uint32(0xC2B2AE35) + x[2:]
    counts = np.zeros(PLACES)
    for grams in (x[1:-1], two, three):
        place = (grams * np.uint32(0x27D4EB2F)) >> np.uint32(32 - PLACES.bit_length() + 1)
        found = np.bincount(place, minlength=PLACES)
        counts += found / found.sum()
    return np.sqrt(counts / counts.sum())


def linear_svm(rows: np.ndarray, signs: np.ndarray, penalty: float = 1.0, rounds: int = 30, seed: int = 7) -> np.ndarray:
    """Weights (the last is the bias) of a linear SVM with squared hinge loss, by dual coordinate descent; classes count alike."""
    rows = np.hstack([rows, np.ones((len(rows), 1), rows.dtype)])
    share = np.where(signs > 0, 0.5 / max(1, (signs > 0).sum()), 0.5 / max(1, (signs < 0).sum()))
    slack = 1 / (2 * penalty * share * len(rows))
    weights, dual, norm = np.zeros(rows.shape[1]), np.zeros(len(rows)), (rows**2).sum(1) + slack
    order = np.random.default_rng(seed)
    for _ in range(rounds):
        for i in order.permutation(len(rows)):
            new = max(0.0, dual[i] - (signs[i] * (rows[i] @ weights) - 1 + slack[i] * dual[i]) / norm[i])
            if new != dual[i]:
                weights += (new - dual[i]) * signs[i] * rows[i]
                dual[i] = new
    return weights


@dataclass
class Model:
    """Family SVMs and, by family, the pair SVMs: each row of ``pairs`` separates two of its languages."""

    families: list[str]
    by_family: np.ndarray
    languages: dict[str, list[str]]
    pairs: dict[str, np.ndarray]

    @classmethod
    def fit(cls, rows: np.ndarray, langs: list[str]) -> Model | None:
        if not langs:
            return None
        names = np.array(langs)
        family = np.array([FAMILY.get(x, x) for x in langs])
        families = sorted(set(family))
        by_family = np.array([linear_svm(rows, np.where(family == f, 1.0, -1.0)) for f in families] if len(families) > 1 else np.zeros((1, rows.shape[1] + 1)))
        languages, pairs = {}, {}
        for f in families:
            languages[f] = sorted(set(names[family == f]))
            found = []
            for a, b in combinations(languages[f], 2):
                of = (names == a) | (names == b)
                found.append(linear_svm(rows[of], np.where(names[of] == a, 1.0, -1.0)))
            pairs[f] = np.array(found)
        return cls(families, by_family, languages, pairs)

    def predict(self, row: np.ndarray) -> tuple[str, float]:
        """The language and a score from 0 to 1: the family's share times the mean share against the other languages of it."""
        x = np.append(row, 1.0)
        margins = 3 * (self.by_family @ x)
        shares = np.exp(margins - margins.max())
        f = int(shares.argmax())
        family, score = self.families[f], float(shares[f] / shares.sum())
        langs = self.languages[family]
        if len(langs) == 1:
            return langs[0], score
        wins = np.zeros((2, len(langs)))
        for (a, b), margin in zip(combinations(range(len(langs)), 2), self.pairs[family] @ x, strict=True):
            share = 1 / (1 + np.exp(-3 * margin))
            wins[:, a] += (share >= 0.5, share)
            wins[:, b] += (share < 0.5, 1 - share)
        best = max(range(len(langs)), key=lambda i: (wins[0, i], wins[1, i], -i))
        return langs[best], score * float(wins[1, best]) / (len(langs) - 1)


def fit(docs: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """A model from the rows where ``learn`` holds and lang and text are not null."""
    usable = docs.where(learn & docs[lang].isNotNull() & docs[text].isNotNull())
    sizes = {r[0]: r[1] for r in usable.groupBy(lang).count().collect()}
    if not sizes:
        return None
    scale = 1 << 30
    each = max(1, sample_rows // len(sizes))
    limit = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, int(scale * min(1.0, each / n)))])
    chosen = usable.where(F.pmod(F.xxhash64(key), F.lit(scale)) < limit[F.col(lang)])

    def make():
        def work(texts: list) -> list:
            found = [features(t) for t in texts]
            return [pa.array([None if x is None else x.astype(np.float16).tobytes() for x in found], pa.binary())]

        return work

    rows = common.map_texts(chosen, [key, lang], text, [T.StructField("row", T.BinaryType())], make).where("row IS NOT NULL").collect()
    rows.sort(key=lambda r: (r[1], r[0], bytes(r[2])))
    matrix = np.array([np.frombuffer(r[2], np.float16) for r in rows], np.float64).reshape(len(rows), PLACES)
    return Model.fit(matrix, [r[1] for r in rows])


def identify(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: key, ``keep``, lang_pred, score."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        own = held.value

        def work(texts: list) -> list:
            found = [("und", 0.0) if own is None or (x := features(t)) is None else own.predict(x) for t in texts]
            return [pa.array([str(a) for a, _ in found], pa.string()), pa.array([b for _, b in found], pa.float64())]

        return work

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return common.map_texts(docs, list(dict.fromkeys([key, *keep])), text, fields, make)


def held_out(key: str, folds: int, fold: int) -> Column:
    """Whether crc32(id as text) mod ``folds`` is ``fold``; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def learnt_from(key: str, folds: int, fold: int) -> Column:
    """The rows to learn from: not held out, and with an id."""
    return ~held_out(key, folds, fold) & F.col(key).isNotNull()
