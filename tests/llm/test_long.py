"""Very long texts, and columns whose names clash with the operators' own."""

import hashlib

from conftest import rows

import corpus_pipeline
from tessera.llm import decontaminate, html, language, lm, pii, secrets, simhash, warc

ITEM = "Alice has 12 red apples in a basket. Bob gives her 5 more apples before lunch. How many red apples does Alice have now?"
LONG = " ".join(f"word{i % 5000} of the very long text" for i in range(60_000))  # 300,000 words, 1.6 MB


def test_long_texts(spark):
    docs = spark.createDataFrame([(1, LONG), (2, f"{LONG} {ITEM} {LONG}"), (3, LONG), (4, "x" * 2_000_000), (5, None)], "doc_id long, text string")
    items = spark.createDataFrame([(9, ITEM)], "item_id long, text string")
    assert rows(decontaminate.contaminated(docs, items), "doc_id", "item_id") == [(2, 9)]
    assert rows(simhash.group(docs), "doc_id", "component_id")[2] == (3, 1)
    assert rows(simhash.similar(docs), "doc_id", "component_id") == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 5)]
    counted = lm.counts(docs.where("doc_id < 4"))
    scored = lm.score(docs, lm.fit(docs, counted, docs.doc_id < 4), counted)
    assert rows(scored, "doc_id", "n_tokens")[0] == (1, 360_001) and all(r.score < 0 for r in scored.collect())
    assert rows(pii.pseudonymise(docs, b"k"), "doc_id", "text") == rows(docs)
    assert secrets.find_secrets(docs).where("size(spans) > 0").count() == 0


def test_long_pages(spark):
    pages = spark.createDataFrame([(i, "http://h/", f"<body><nav>menu</nav><p>{i} {LONG}</p></body>") for i in range(4)], "page_id long, url string, html string")
    assert rows(html.extract(pages), "page_id", "text") == [(i, f"{i} {LONG}") for i in range(4)]
    found = warc.round_trip(pages.union(pages.selectExpr("page_id + 10", "url", "html")))
    digests = {i: hashlib.sha1(f"<body><nav>menu</nav><p>{i} {LONG}</p></body>".encode()).hexdigest() for i in range(4)}
    assert rows(found, "page_id", "payload_digest", "refers_to") == [*[(i, digests[i], i + 10) for i in range(4)], *[(i + 10, digests[i], None) for i in range(4)]]


CLASHES = "fp fps own cell one two root band text2 component_id w0 small rep score lang_pred n_tokens spans ids entities token row host sign doc hash words".split()


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(i, f"the quick brown fox jumps over the lazy dog number {i} mail a{i}@b.com", "en", "s", 9) for i in range(6)], "doc_id long, text string, lang string, source string, n_chars long")
    wide = docs.selectExpr("*", *[f"7 AS `{c}`" for c in CLASHES])
    for run in (
        lambda d: simhash.digests(simhash.group(d)), simhash.similar, secrets.find_secrets, lm.counts,
        lambda d: language.identify(d, language.fit(d, language.learnt_from("doc_id", 3, 1))),
        lambda d: decontaminate.contaminated(d, spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog", 3)], "item_id long, text string, hash long")),
    ):
        assert rows(run(wide)) == rows(run(docs))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, wide, "/root/testdata/sf0.001").columns == wide.columns


def test_kept_texts_are_sent_once(spark):
    docs = spark.createDataFrame([(1, "abc", "en"), (2, None, "en")], "doc_id long, text string, lang string")
    both = language.identify(docs, None, keep=("doc_id", "text", "lang"))
    assert rows(both) == [(1, "abc", "en", "und", 0.0), (2, None, "en", "und", 0.0)]
    assert "__text" not in both._jdf.queryExecution().analyzed().toString()
    assert rows(language.identify(docs, None)) == [(1, "und", 0.0), (2, "und", 0.0)]
