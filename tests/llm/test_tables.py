"""Operators over tables against brute force: decontamination, LM scores, WARC, HTML, SimHash, top-k, the pipeline."""

import hashlib
import io
import math
import os
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from conftest import SF, rows

import corpus_pipeline
from test_similar import plain_components as similar_components
from tessera.llm import byte_bpe, common, decontaminate, graph, html, language, lm, pii, queries, simhash, topk, warc

DOCS = "doc_id long, text string, digest string, fp string, item_id long"


def frame(spark, data, schema=DOCS):
    n = schema.count(",") + 1
    return spark.createDataFrame([(*r, *["x"] * (n - len(r) - 1), None) if len(r) < n else r for r in data], schema)


# ---- decontamination -------------------------------------------------------------------------------------

ITEM = "Tom has 5 apples and Mary has 7 apples. If Tom gives Mary 2 apples, how many apples does Tom have now in total"


def contaminated(spark, docs, items):
    found = decontaminate.contaminated(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    return rows(found, "doc_id", "item_id", "reparameterised")


def test_templates(spark):
    other = ITEM.replace("5", "15").replace("7", "17").replace(" 2 ", " 12 ").replace("Mary", "Kate")
    docs = [
        (1, f"Before. {ITEM}. After"), (2, other), (3, other.replace("Tom have", "Bob have").replace("If Tom", "If Jim").replace("and Kate", "and Ann")), (4, None), (5, ""), (6, "Something else entirely is here"), (None, ITEM.upper()),
        (7, ITEM.replace(" ", "  ").replace("apples", "apples;")), (1, f"Before. {ITEM}. After"),
    ]
    found = contaminated(spark, docs, [(9, ITEM), (10, None), (11, "")])
    assert found[:2] == [(1, 9, False), (2, 9, True)] and {d for d, *_ in found} <= {1, 2, 7, None}


def test_decontamination_edges(spark):
    assert contaminated(spark, [], [(9, ITEM)]) == [] and contaminated(spark, [(1, ITEM)], []) == []
    assert contaminated(spark, [(1, "red words"), (2, "the red words here"), (3, "1 2 3 4 5 6 7")], [(9, "red words"), (8, "9 8 7 6 5 4 3")]) == [(1, 9, False)]
    assert contaminated(spark, [(1, ITEM)], [(9, ITEM), (10, ITEM), (None, ITEM)]) == [(1, 9, False), (1, 10, False), (1, None, False)]


def test_planted_items_are_found(spark):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    items = bench.collect()
    wanted = {(d.doc_id, i.item_id) for d in docs.collect() for i in items if d.text and i.text in d.text}
    found = {(r.doc_id, r.item_id) for r in queries.op1_decontamination(spark, SF).collect()}
    texts = {d.doc_id: d.text for d in docs.collect()}
    assert wanted <= found and all(i.text.lower() in texts[d].lower() for d, n in found for i in items if i.item_id == n)


def test_decontamination_is_native(spark):
    plan = queries.op1_decontamination(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian", plan)


# ---- language model --------------------------------------------------------------------------------------


def test_base_scores(spark, monkeypatch):
    monkeypatch.setattr(lm, "MAPPED", 300)  # so that most tokens go by the join
    scored = {r.doc_id: r for r in queries.op2_lm_score(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    tokens = {d.doc_id: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), d.text or "")), None] for d in docs}
    counts = Counter(t for i, ts in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2 for t in ts)
    n, v = sum(counts.values()), len(counts)
    for i, ts in tokens.items():
        r = scored[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ts), sum(counts[t] > 0 for t in ts), n)
        assert r.base_score == pytest.approx(math.fsum(math.log10((counts[t] + 1) / (n + v + 1)) for t in ts), rel=1e-9)
    held = [r for r in scored.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_network_is_normalised_and_carries_its_state():
    net = lm.Network(120)
    rng = np.random.default_rng(0)
    h = rng.standard_normal((1, lm.UNITS)).astype(np.float32)
    every = np.array([*range(120), *range(net.shared, net.start)])
    assert len(every) == 120 + lm.LEAST_TAILS * lm.PER_CLASS
    assert np.exp(net.log_probs(np.repeat(h, len(every), 0), every)).sum() == pytest.approx(1, abs=1e-4)
    docs = [rng.choice(every, n) for n in (1, 5, 64, 65, 200, 130)]
    by_hand = []
    for d in docs:
        state, total, before = np.zeros((1, lm.UNITS), np.float32), 0.0, net.start
        for t in d:
            state = net.step(state, np.array([before]))[0]
            total, before = total + net.log_probs(state, np.array([t]))[0], t
        by_hand.append(total)
    assert net.score(docs) == pytest.approx(by_hand, rel=1e-4)
    assert net.score([]).tolist() == []


def test_gradients_are_right():
    net = lm.Network(60)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(1)
    every = np.array([*range(60), *range(net.shared, net.start)])
    ids, goals = rng.choice(every, (4, 3)), rng.choice(every, (4, 3))
    keep, weight, h = np.ones((4, 3)), np.ones((4, 3)), np.zeros((3, lm.UNITS))
    keep[2, 1], weight[3, 2] = 0, 0

    def loss():
        state, total = h, 0.0
        for t in range(4):
            state = net.step(state * keep[t][:, None], ids[t])[0]
            total -= (net.log_probs(state, goals[t]) * weight[t]).sum()
        return total / weight.sum()

    g, read, _ = net.gradients(h, ids, goals, keep, weight)
    inputs = np.zeros_like(net.p["input"])
    inputs[read] = g["input"]
    g["input"] = inputs
    for name in ("input", "state", "cls", "cls_b", "word"):
        flat, own = net.p[name].reshape(-1), g[name].reshape(-1)
        for i in np.argsort(-abs(own))[:4]:
            at, eps = flat[i], 1e-5
            flat[i] = at + eps
            up = loss()
            flat[i] = at - eps
            down = loss()
            flat[i] = at
            assert own[i] == pytest.approx((up - down) / (2 * eps), rel=2e-2, abs=1e-6)


def test_training_helps():
    rng = np.random.default_rng(2)
    docs = [np.array([0, 1, 2, 3, 4] * rng.integers(3, 9)) for _ in range(40)]
    net = lm.Network(60)
    before = net.score(docs).sum()
    assert net.learn(((d, 0) for _ in range(6) for d in docs), rate=0.03, streams=8) == 6 * sum(map(len, docs))
    assert net.score(docs).sum() > before / 3
    again = lm.Network(60, seed=3)
    again.unpack(net.packed())
    assert again.score(docs) == pytest.approx(net.score(docs))


def test_untrained_network_is_the_unigram_model():
    masses = np.array([*range(50, 0, -1), *[0] * 50, *range(400)], float)
    masses[50:60], masses[60:100] = 7, 0
    net = lm.Network(60, masses=masses)
    state = np.zeros((460, lm.UNITS), np.float32)
    every = np.array([*range(60), *range(100, 500)])
    found = np.exp(net.log_probs(state, every))
    assert found == pytest.approx(masses[every] / masses.sum(), abs=2e-3)


def test_passages_cover_all_parts():
    """Over many documents one passage in EVERY is learnt, from any place; what is learnt grows with the corpus."""
    rng = np.random.default_rng(9)
    docs = [rng.integers(0, 400, n) for n in rng.integers(1, 3000, 400)]
    found = [x for d in docs for x in lm.passages(d)]
    n = sum(-(-len(d) // lm.PASSAGE) for d in docs)
    assert 0.8 < len(found) * lm.EVERY / n < 1.2 and {r for r, _, _ in found} == set(range(lm.ROUNDS))
    assert all(len(x) - read <= lm.PASSAGE and read in (0, lm.WINDOW) for _, x, read in found)
    assert sum(read == 0 for *_, read in found) < len(found) / 2
    half = [x for d in docs[:200] for x in lm.passages(d)]
    assert 0.4 < len(half) / len(found) < 0.6


def test_every_token_is_learnt_once():
    rng = np.random.default_rng(4)
    for d in [rng.integers(0, 400, n) for n in (1, 2, lm.PASSAGE, lm.PASSAGE + 1, 5000)]:
        found = [x[read:] for _, x, read in lm.passages(d)]
        assert np.concatenate(found).tolist() == d.tolist()


def test_scores_by_hand(spark, monkeypatch):
    """The score of whole documents: every token's class, number and share, with the state carried from the first token to the last."""
    monkeypatch.setattr(lm, "MAPPED", 500)
    monkeypatch.setattr(lm, "HEAD", 230)
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    learn = language.learnt_from("doc_id", 7, 2)
    counted = lm.counts(docs.where(learn))
    model = lm.fit(docs, counted, learn)
    counts, net = {bytes(r.token): r.c for r in counted.collect()}, model.network
    heads = sorted(counts, key=lambda t: (-counts[t], t))[:230]
    assert net.heads == 230 and len(model.table) <= 500 < len(counts)
    totals = Counter()
    for t, c in counts.items():
        if t not in heads:
            totals[lm.bucket(t, net.tails)] += c + 1
    scored = {r.doc_id: r.score for r in lm.score(docs, model, counted).collect()}
    for d in docs.collect():
        state, before, total = np.zeros((1, lm.UNITS), np.float32), net.start, 0.0
        for t in lm.tokens_of(d.text):
            state = net.step(state, np.array([before]))[0]
            number = heads.index(t) if t in heads else net.shared + lm.bucket(t, net.tails)
            total += net.log_probs(state, np.array([number]))[0] / math.log(10)
            if t not in heads:
                total += math.log10((counts.get(t, 0) + 1) / (totals[lm.bucket(t, net.tails)] + 1))
            before = number
        assert scored[d.doc_id] == pytest.approx(total, rel=1e-4)


def test_lm_edges(spark):
    docs = frame(spark, [(2, None), (3, ""), (None, "a b"), (3, ""), (5, "a A b"), (6, "z" * 50_000)])
    learn = language.learnt_from("doc_id", 7, 2)
    counted = lm.counts(docs.where(learn))
    found = lm.score(docs, lm.fit(docs, counted, learn), counted)
    assert [(r.n_tokens) for r in found.orderBy("n_tokens").collect()] == [1, 1, 1, 2, 3, 4]
    none = docs.limit(0)
    counted = lm.counts(none)
    model = lm.fit(none, counted, learn)
    assert lm.score(none, model, counted).count() == 0
    alone = lm.score(docs, model, counted).where("doc_id = 5").first()
    assert (alone.n_known, alone.train_tokens, alone.base_score) == (0, 0, 0.0)


def test_tokens_by_arrow():
    texts = ["", None, "  ", " a", "b ", "A  B\tc\r\n\x0b\x0cd", "À\x1c\x1fÉ c\x85D\u2028E\x00F", "\t", "x" * 70_000, "ſ K İ"]
    tokens, lengths = lm.split(pa.array(texts))
    wanted = [lm.tokens_of(t) for t in texts]
    assert tokens.to_pylist() == [w for ws in wanted for w in ws] and lengths.tolist() == [len(ws) for ws in wanted]


def test_windows_without_goals_take_no_step(monkeypatch):
    """What is only read is passed through the states alone: neither output layers nor a step of Adam are spent on it."""
    steps, own = [], lm.Network.gradients
    monkeypatch.setattr(lm.Network, "gradients", lambda self, *a: steps.append(a[-1].sum()) or own(self, *a))
    net = lm.Network(60)
    assert net.learn(iter([(np.arange(3 * lm.WINDOW) % 60, lm.WINDOW)] * 4)) == 8 * lm.WINDOW
    assert steps == [4 * lm.WINDOW] * 2


def test_large_logits():
    """Rows whose exponentials leave the range of 32-bit numbers give the same shares as shifted ones."""
    x = np.array([[0, 1, 2], [500, 501, 502], [-500, -501, -499]], np.float32)
    found, sums, at = lm.exponentials(lambda: x.copy(), np.array([0, 2, 1]))
    wanted = np.exp(x.astype(float) - x.max(1, keepdims=True))
    assert found / sums[:, None] == pytest.approx(wanted / wanted.sum(1, keepdims=True), rel=1e-5)
    assert np.exp(at) / sums == pytest.approx(wanted[[0, 1, 2], [0, 2, 1]] / wanted.sum(1), rel=1e-5)


def test_sums_of_rows():
    rng = np.random.default_rng(5)
    x, rows = np.concatenate([rng.integers(0, 40, 300), np.full(100, 7)]), rng.standard_normal((400, 6))
    order, found, first, n = lm.ordered(x, 50)
    assert found.tolist() == np.unique(x).tolist() and n.sum() == 400
    assert lm.summed(rows, order, first, n) == pytest.approx(np.array([rows[x == k].sum(0) for k in found]))


# ---- WARC ------------------------------------------------------------------------------------------------


def test_warc_round_trip(spark):
    same = "x" * 1500
    pages = [(1, "http://a/", same), (2, "http://b/\r\nX: y", same), (3, None, "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (None, "u", same), (2, "http://b/", same), (7, "é", "ü" * 900)]
    found = warc.round_trip(frame(spark, pages, "page_id long, url string, html string, sha string, n string"))
    key = lambda h: (len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest())
    wanted = [(i, *key(h), "revisit" if i == 1 else "response", 2 if i == 1 else None) for i, _, h in pages]
    order = lambda r: tuple((x is None, x) for x in r)
    assert rows(found, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == sorted(wanted, key=order)
    assert warc.round_trip(frame(spark, [], "page_id long, url string, html string, sha string, n string")).count() == 0


def test_warc_records_are_members():
    data = b"".join(warc.member(warc.record(i, f"http://h/{i}", b"<p>" * i * 40_000)) for i in range(4))
    assert [(r["page_id"], r["payload_bytes"]) for r in warc.records(io.BytesIO(data).read)] == [(i, i * 120_000) for i in range(4)]
    import gzip

    text = gzip.decompress(data).decode()
    assert text.count("WARC/1.1\r\n") == 4 and "WARC-Type: response" in text


@pytest.mark.parametrize("spoil", [lambda r: r.replace(b"<p>hello", b"<p>jello"), lambda r: r[:-4] + b"more" + r[-4:], lambda r: r[:-20], lambda r: b"HTTP" + r[4:]])
def test_spoilt_records_are_told(spoil):
    data = warc.member(spoil(warc.record(1, "u", b"<p>hello world, this is a page")))
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(data).read))
    whole = warc.member(warc.record(1, "u", b"abc"))
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(whole[:-12]).read))


# ---- HTML ------------------------------------------------------------------------------------------------


def test_generated_pages(spark):
    found = {r.page_id: r.text for r in queries.op5_html(spark, SF).collect()}
    import html as entities

    for p in spark.read.parquet(f"{SF}/pages.parquet").collect():
        article = re.search("<article>(.*?)</article>", p.html, re.S)[1]
        blocks = (" ".join(entities.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", article))
        assert found[p.page_id] == "\n".join(b for b in blocks if b)


def page(body, extra=""):
    return f'<html><head><title>t</title><style>p{{}}</style></head><body><header>Site</header><nav>menu</nav><div class="content">{body}</div><div id="sidebar">side</div>{extra}<footer>foot</footer></body></html>'


def test_template_furniture_goes(spark):
    pages = [(i, "http://h.example/x", page(f"<p>About us</p><h2>Title {i}</h2><p>Text&nbsp;{i} &lt;b&gt;<br>more &amp; <i>more</i></p><ul><li>one {i}<li>two {i}</ul>"), 0) for i in range(6)]
    pages += [(10, None, None, 0), (11, "", "", 0), (12, "http://other/", "plain words", 0), (13, "http://other2/", "<p>a<script>x('</p>')</script>b<!-- no --><div>c</div", 0), (3, "http://h.example/x", page("<p>twice</p>"), 0)]
    found = html.extract(spark.createDataFrame(pages, "page_id long, url string, html string, template long"))
    texts = {(r.page_id, r.text) for r in found.collect()}
    for i in (0, 1, 2, 4, 5):
        assert (i, f"Title {i}\nText {i} <b> more & more\none {i}\ntwo {i}") in texts
    assert {(10, ""), (11, ""), (12, "plain words"), (13, "ab\nc"), (3, "twice")} <= texts
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_repeated_passages_in_articles_stay(spark):
    pages = [(i, "http://h/", f"<body><nav>n</nav><article><h1>T{i}</h1><p>Licensed to all.</p><p>x{i}</p><div class='comments'>nice!</div><form>f</form></article><aside>a</aside></body>") for i in range(5)]
    found = html.extract(spark.createDataFrame(pages, "page_id long, url string, html string"))
    assert rows(found, "page_id", "text") == [(i, f"T{i}\nLicensed to all.\nx{i}") for i in range(5)]


def typed(i, kind):
    """A page without an article element: the host's frame, and the frame of one of two page types."""
    inner = {"a": f"<div class=w1><b>Our shop notice</b></div><div class=w2>Goods {i}</div>", "b": f"<ul class=w3><li>Imprint text<li>Second line</ul><div class=w4><p>News {i}</p></div>"}[kind]
    return f"<html><body><div class=top>Welcome text</div>{inner}<div class=end>All rights</div></body></html>"


def test_valid_classes(spark):
    """Against the definition: true occurrence vectors, same slot and place on every page."""
    pages = [(i, "http://h/", typed(i, "a")) for i in range(7)] + [(10 + i, "http://h/", typed(i, "b")) for i in range(3)]
    pages += [(20 + i, "http://h/", f"<html><body>{''.join(f'<p>{w}</p>' for w in ('one', 'two', 'one', 'two')[i : i + 2])}<i>x</i><u>y</u></body></html>") for i in range(3)]
    pages += [(30, "http://one/", "<body><p>x</p></body>")] + [(40 + i, "http://copies/", "<body><p>x</p></body>") for i in range(9)]
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    counts = [html.occurrences(h) for _, u, h in pages if u == "http://h/"]
    every = {t for c in counts for t in c}
    vector = {t: tuple(c.get(t, 0) for c in counts) for t in every}
    classes = {}
    for t, v in vector.items():
        classes.setdefault(v, set()).add(t)
    n = lambda v: sum(x > 0 for x in v)
    fine = {v: own for v, own in classes.items() if n(v) >= 3 and len(own) >= 2 and sum(t % 2 == 0 for t in own) >= (1 if 2 * n(v) >= len(counts) else 2)}
    found = html.candidates(table).collect()
    assert {r.host for r in found} == {"h"}
    by_sign = {}
    for r in found:
        by_sign.setdefault(r.sign, set()).add(r.token)
    assert sorted(map(sorted, by_sign.values())) == sorted(map(sorted, fine.values()))
    main = max(fine, key=lambda v: (n(v), len(fine[v])))
    kept = set()
    for v, own in fine.items():
        for t in own:
            seen = set()
            for c in counts:
                if t in c:
                    order = [x for x in c if any(x in f for f in fine.values())]
                    before = order[: order.index(t)]
                    seen.add((0 if v == main else sum(x in fine[main] for x in before), sum(x in own for x in before)))
            kept |= {t} if len(seen) == 1 else set()
    template = html.templates(table).collect()
    assert {r.token for r in template} == kept and kept < {t for own in fine.values() for t in own}
    assert html.token_key("/html/body/div.w1/b", "Our shop notice") in kept and html.token_key("/html/body/div.w2", "Goods 1") not in kept


def test_the_template_decides(spark):
    """Furniture of each page type goes by the template alone: no label marks it, and pages have no article."""
    pages = [(i, "http://h/", typed(i, "a")) for i in range(7)] + [(10 + i, "http://h/", typed(i, "b")) for i in range(3)] + [(20, "http://alone/", typed(1, "a"))]
    found = rows(html.extract(spark.createDataFrame(pages, "page_id long, url string, html string")), "page_id", "text")
    assert found == [(i, f"Goods {i}") for i in range(7)] + [(10 + i, f"News {i}") for i in range(3)] + [(20, "Welcome text\nOur shop notice\nGoods 1\nAll rights")]


def test_labels_are_of_slots(spark):
    """A label counts if its element is of the template, in an article only as a whole name."""
    body = "<body><article><div class='entry-header'><h1>T{i}</h1></div><p class='share-price'>P{i}</p><div class='banner'>B{i}</div><div class='comment-list'>c{i}</div>{odd}</article></body>"
    pages = [(i, "http://h/", body.format(i=i, odd="<div class='related'>my relatives</div>" if i == 2 else "")) for i in range(4)]
    found = rows(html.extract(spark.createDataFrame(pages, "page_id long, url string, html string")), "page_id", "text")
    assert found == [(i, f"T{i}\nP{i}\nB{i}" + "\nmy relatives" * (i == 2)) for i in range(4)]


def test_templates_by_a_join(spark, monkeypatch):
    monkeypatch.setattr(html, "SENT_TOKENS", 0)
    test_the_template_decides(spark)


@pytest.mark.parametrize("piece", ["<b x", "<b x=\"", "<b>", "<b x='><p>", "<!--", "<script>", "< ", "</p>", "<p><b>", "<li><div class='a b c'>"])
def test_broken_pages_take_linear_time(piece):
    import time

    text = "start " + piece * (1_000_000 // len(piece)) + "<p>end</p>"
    began = time.time()
    html.main_text(text, None)
    assert time.time() - began < 8  # seconds of a loaded machine; quadratic time would be hours


def test_long_and_odd_pages():
    words = "word " * 100_000
    assert html.main_text(f"<p>{words}</p>", None) == words.strip()
    assert html.main_text("<p title='a > b'>x</p><p title=\"<i>\">y</p>", None) == "x\ny"
    assert html.main_text("a <3 b < c<p>d</p> <y and z", None) == "a <3 b < c\nd"
    assert html.main_text('<p>one</p><a href="x>two</a><p>three</p>', None).split()[0] == "one"
    assert html.main_text("<div>" * 5000 + "deep" + "</div>" * 5000 + "<p>after</p>", None) == "deep\nafter"


# ---- SimHash ---------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_simhash_is_brute_force(spark):
    data = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    data += [(10**6 + i, t) for i, t in enumerate([None, "", "\n\t", "one", "one two three", "One two THREE"])] + [data[3]]
    found = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.digests(simhash.group(frame(spark, data))).collect()}
    fps = [plain_fingerprint(t) for _, t in data]
    parts = plain_components(fps)
    least = {p: min(data[i][0] for i in range(len(data)) if parts[i] == p) for p in parts}
    assert found == {(data[i][0], f"{fps[i]:016x}", least[parts[i]]) for i in range(len(data))}


def test_hot_cells_are_cut(spark):
    rng = np.random.default_rng(4)
    base = int(rng.integers(2**63))
    fps = sorted({base ^ sum(1 << int(b) for b in rng.integers(0, 40, rng.integers(0, 4))) for _ in range(300)} | {int(x) for x in rng.integers(0, 2**63, 100)})
    table = spark.createDataFrame([(x,) for x in fps], "fp long")
    parts = plain_components(fps)
    for cell, m in ((8192, 1), (16, 1), (8192, 3), (8, 2), (2, 4)):
        found = dict(rows(graph.components(simhash.links(table, cell=cell, m=m))))
        assert {fps[i]: fps[p] for i, p in enumerate(parts) if parts.count(p) > 1} == found


def test_keys_grow_with_the_number_of_fingerprints():
    assert [simhash.agreeing(n) for n in (0, 10**5, 10**7, 10**9, 10**13)] == [1, 1, 2, 3, 4]
    for m in (1, 2, 3, 4):
        assert sum(mask.bit_count() for _, mask in simhash.blocks_of(4, m)) == 64 and len(simhash.blocks_of(4, m)) == 4 + m


def test_links_between_chunks(spark):
    """Two groups that only one bridge of a hot cell connects, whatever chunk it falls into."""
    base = 0x0123456789ABCDEF
    left = [base ^ (1 << i) for i in range(30)]
    right = [base ^ (0b111111 << 40) ^ (1 << i) for i in range(30)]
    bridge = [base ^ (0b111 << 40)]
    table = spark.createDataFrame([(x,) for x in left + right + bridge], "fp long")
    for cell in (8192, 4):
        found = dict(rows(graph.components(simhash.links(table, cell=cell))))
        assert set(found.values()) == {min(left + right + bridge)} and len(found) == 61


def test_simhash_null_ids_and_empty(spark):
    found = simhash.group(frame(spark, [(None, "a b c d e"), (4, "a b c d e"), (None, "other words are here now")]))
    assert rows(found, "doc_id", "component_id") == [(4, 4), (None, 4), (None, None)]
    assert simhash.group(frame(spark, [])).count() == 0


def test_pivots_never_lose_a_link():
    rng = np.random.default_rng(5)
    fps = rng.integers(0, 2**63, 50).astype(np.uint64)
    near = np.concatenate([fps, fps ^ np.uint64(0b1111), fps ^ np.uint64(0b11111)])
    i, j = simhash.forest(near, np.zeros(len(near), int))
    assert len(i) == 100 and (np.bitwise_count(near[i] ^ near[j]) <= 4).all()  # 50 trees of three
    assert len(simhash.forest(near, np.zeros(len(near), int), wanted=np.arange(len(near)) % 50)[0]) == 0
    assert len(simhash.forest(near, np.arange(len(near)))[0]) == 0


def test_components_of_a_chain(spark):
    chain = [(i, i + 1) for i in range(1, 60)] + [(100, 100), (200, 201)]
    assert rows(graph.components(spark.createDataFrame(chain, "a long, b long"))) == [(i, 1) for i in range(1, 61)] + [(200, 200), (201, 200)]


# ---- top-k -----------------------------------------------------------------------------------------------


def test_top_k_is_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 3)  # several blocks of queries
    monkeypatch.setattr(topk, "SLICE", 4000)  # several slices of candidates
    rng = np.random.default_rng(6)
    vectors = [(i, [float(x) for x in rng.standard_normal(8)]) for i in range(300)]
    vectors[50] = (50, vectors[51][1])
    vectors += [(400, None), (450, [1.0, None]), (500, [float("nan")] * 8), (550, [float("inf")] * 8), (600, [0.5] * 3), (None, [0.1] * 8), (650, []), (7, vectors[7][1])]
    table = spark.createDataFrame([(*v, 1, 2) for v in vectors], "vec_id long, embedding array<float>, score int, rank int")
    whole = [(i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(np.int64)) for i, v in vectors if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    wanted = []
    for q, x in whole:
        if q % 50 == 0:
            best = sorted((-int(x @ y), i) for i, y in whole if i != q and len(y) == len(x))[:5]
            wanted += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    found = topk.search(table, __import__("pyspark.sql.functions", fromlist=["x"]).expr("id % 50 = 0"))
    assert rows(found) == sorted(wanted)
    assert topk.search(table.limit(0), __import__("pyspark.sql.functions", fromlist=["x"]).expr("id % 50 = 0")).count() == 0


def test_the_uniform_threshold_prunes():
    """Phases 2 and 3 touch the entries of T / lists and above in some list, and no others."""
    rng = np.random.default_rng(8)
    x = np.floor(rng.standard_normal((2000, 32)) * 256)
    asks, names = np.arange(0, 2000, 50), np.arange(2000)
    whole = (x[asks] @ x.T).astype(np.int64)
    whole[names[None, :] == asks[:, None]] = topk.NONE
    q, i, s = topk.local_best(asks, x[asks], names, x, 5)
    assert (s == whole[q // 50, i]).all() and len(q) == 5 * len(asks)
    cutoffs = np.array([np.sort(s[q == a])[0] for a in asks])
    found = set(zip(*map(np.ndarray.tolist, topk.sufficient(x[asks], cutoffs, x)), strict=True))
    halves = [(x[asks][:, of] @ x[:, of].T) * 2 >= cutoffs[:, None] for of in (slice(0, 16), slice(16, 32))]
    assert found == set(zip(*map(np.ndarray.tolist, np.nonzero(halves[0] | halves[1])), strict=True)) and len(found) < whole.size / 8
    assert {(a, b) for a, b, _ in zip(*map(np.ndarray.tolist, topk.reaching(asks, x[asks], cutoffs, names, x)), strict=True)} == {(int(asks[a]), b) for a, b in zip(*map(np.ndarray.tolist, np.nonzero(whole >= cutoffs[:, None])), strict=True)}


def test_large_components(spark):
    assert topk.products(np.array([[2.0**30, 1.0]]), np.array([[2.0**30, 1.0]])).tolist() == [[2**60 + 1]]
    with pytest.raises(OverflowError):
        topk.products(np.array([[2.0**40]]), np.array([[2.0**40]]))


# ---- pipeline --------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    more = [
        (10**6, "!!! 123", "en", "s", 7), (10**6 + 1, "Alone with " + item, "en", "s", 9), (10**6 + 2, "My own words for a.b@mail1.example.com only", "en", "s", 1), (10**6 + 2, "My own words for a.b@mail1.example.com only", "en", "s", 1),
        (None, None, None, None, None), (None, "A nameless but clean text of some words", "en", "s", 1),
    ]
    docs = docs.union(spark.createDataFrame(more, docs.schema))
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, kept[-1], SF).write.parquet(str(tmp_path / name))
        kept.append(spark.read.parquet(str(tmp_path / name)))
    by = [{r.doc_id for r in k.select("doc_id").collect()} for k in kept]
    assert all(k.columns == docs.columns for k in kept[:-1])
    assert by[0] - by[1] == {10**6}
    grouped = similar_components([r.text for r in kept[1].collect()])  # five words, 0.8
    assert kept[2].count() == len(set(grouped)) and kept[2].where(f"doc_id = {10**6 + 2}").count() == 1
    gone = by[2] - by[3]
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    texts = {r.doc_id: r.text for r in kept[2].collect()}
    assert 10**6 + 1 in gone and all(any(b.lower() in texts[i].lower() for b in bench) for i in gone)
    assert all(not any(b in t for b in bench) for i, t in texts.items() if i in by[3])
    before, after = {r.doc_id: r for r in kept[3].collect()}, {r.doc_id: r for r in kept[4].collect()}
    assert {i for i in before if before[i].text != after[i].text} == {i for i in before if pii.detect(before[i].text)}
    assert all(r.n_chars == len(r.text) for r in after.values())
    bpe = byte_bpe.tokenizer(queries.RANKS, queries.PATTERN)
    for r in kept[5].collect():
        assert r.decoded_sha256 == hashlib.sha256(after[r.doc_id].text.encode()).hexdigest() and r.n_tokens == len(list(bpe.encode(after[r.doc_id].text)))


def test_run(spark):
    made = corpus_pipeline.run(spark, SF)
    assert made.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and made.count() > 100


def test_tables_are_released(spark, tmp_path):
    paths = []

    def make():
        first = common.materialise(spark.range(5).toDF("x"), "first")
        paths.extend(first.inputFiles())
        return first.where("x > 2")

    out = common.released(spark, make, "out")
    assert rows(out) == [(3,), (4,)] and not any(os.path.exists(p.removeprefix("file://")) for p in paths) and paths


def test_shared_folder_is_asked_for(spark):
    class Cluster:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Cluster)


def test_pipeline_keeps_clashing_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(20).selectExpr("*", "1 AS score", "2 AS entities", "3 AS lang_pred")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns[-3:] == ["score", "entities", "lang_pred"]
    assert docs.first().score == 1
