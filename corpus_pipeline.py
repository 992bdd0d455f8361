"""The corpus pipeline: language ID, near-duplicates, benchmark decontamination, PII surrogates, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last
return the columns of ``docs``. ``run`` applies them to the table ``documents``, each result written as
Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessera.llm import byte_bpe, common, decontaminate, language, pii, queries, simhash

#: Ids that are broadcast at most to drop their rows; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def named(key: str, digest) -> Column:
    """What names a row: its id, nulls last, and its text's hash."""
    return F.struct(F.col(key).isNull().alias("nameless"), F.col(key).alias("id"), digest.alias("digest"))


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose name is not in ``dropped`` (__doc)."""
    dropped = common.materialise(dropped.select("__doc").distinct(), "dropped")
    if dropped.count() <= BROADCAST_IDS:
        dropped = F.broadcast(dropped)
    return docs.withColumn("__doc", named("doc_id", F.xxhash64("text"))).join(dropped, "__doc", "left_anti").select(*docs.columns)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter, whose language is undetermined; ``lang`` becomes the predicted language."""
    model = language.fit(docs, language.learnt_from("doc_id", 3, 1))
    clash = [c for c in docs.columns if c in ("lang_pred", "score")]
    plain = docs.withColumnsRenamed({c: f"__{c}" for c in clash})
    found = language.identify(plain, model, keep=tuple(plain.columns)).where(F.col("lang_pred") != "und")
    kept = found.withColumn("lang", F.col("lang_pred")).drop("lang_pred", "score")
    return kept.withColumnsRenamed({f"__{c}": c for c in clash}).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of texts whose five-word shingles are alike by 0.8 or more: that with the least id, and of several rows with that id the least hash of the text."""
    rows = docs.withColumn("__doc", named("doc_id", F.xxhash64("text")))
    grouped = common.materialise(simhash.similar(rows.select("__doc", "text"), key="__doc"), "grouped")
    first = F.col("__doc").eqNullSafe(F.col("component_id"))
    kept = without(docs, grouped.where(~first))
    repeated = common.materialise(grouped.where(first).groupBy("__doc").count().where("count > 1").select("__doc"), "repeated")
    if repeated.isEmpty():
        return kept
    again = rows.join(repeated, "__doc", "left_semi").dropDuplicates(["__doc"]).select(*docs.columns)
    return without(kept, repeated).unionByName(again)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    found = decontaminate.contaminated(docs, queries.table(spark, sf_dir, "benchmark"))
    return without(docs, found.select(named("doc_id", F.col("digest")).alias("__doc")))


def replace_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Surrogates for personal data; ``n_chars`` follows the new text."""
    clash = {"entities": "__entities"} if "entities" in docs.columns else {}
    done = pii.pseudonymise(docs.withColumnsRenamed(clash), queries.KEY).drop("entities")
    done = done.withColumnsRenamed({b: a for a, b in clash.items()})
    if "n_chars" in docs.columns:
        length = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        done = done.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(length))
    return done.select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document, and of the bytes that its ids decode to."""
    return byte_bpe.digested(docs, queries.RANKS, queries.PATTERN)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", replace_private),
    ("byte_bpe", encode),
]

#: The stages' models and sketches have no SQL form; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Of what a stage writes on its way only its result stays, until the next stage has read it."""
    docs, before = queries.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = common.released(spark, lambda docs=docs, stage=stage: stage(spark, docs, sf_dir), name)
        if before is not None:
            common.remove(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
