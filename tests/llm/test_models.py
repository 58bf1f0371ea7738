"""The recurrent models: gradients by differences, held-out accuracy, edge rows."""

import zlib

import numpy as np
import pytest

from drawloom.llm import html_blocks as hb
from drawloom.llm import toxicity as tx
from drawloom.llm.catalog import QUERIES


def loss_tox(w, batch):
    features, rows, labels = batch
    x = tx.inputs(w, features)
    p = tx.score_windows(w, x @ w["f_w"] + w["f_b"], x @ w["b_w"] + w["b_b"], rows)
    return -float(np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p)))


def loss_html(w, batch):
    pages, labels = batch
    x, places, _ = hb._inputs(w, pages)
    states, _, mask = hb._states(w, x, places)
    p = 1 / (1 + np.exp(-(states @ w["out_w"] + w["out_b"])))
    y = np.concatenate(labels)[np.maximum(places, 0)]
    on = (y >= 0) * mask[..., 0]
    return -float((on * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / on.sum())


def check_gradients(weights, loss, gradients, batch):
    w = {k: v.astype(np.float64) for k, v in weights.items()}
    g, rng = gradients(w, batch), np.random.default_rng(0)
    for name in w:
        flat = np.flatnonzero(np.abs(g[name]) > 1e-6)
        for at in rng.choice(flat, min(4, len(flat)), replace=False):
            where, step = np.unravel_index(at, w[name].shape), 1e-3
            old = w[name][where]
            w[name][where] = old + step
            up = loss(w, batch)
            w[name][where] = old - step
            down = loss(w, batch)
            w[name][where] = old
            assert g[name][where] == pytest.approx((up - down) / (2 * step), rel=0.03, abs=2e-5), name


def test_gru_gradients():
    vocabulary = tx.Vocabulary(["you idiot there", "idiot words"], ["calm words there", "other text"])
    tokens = ["you", "idiot", "calm", "words", "über"]
    rows = np.full((3, tx.WINDOW), -1)
    rows[0, :5], rows[1, :3], rows[2, :1] = [0, 1, 2, 3, 4], [3, 2, 1], [4]
    check_gradients(tx.starting_weights(), loss_tox, tx.gradients, (vocabulary.features(tokens), rows, np.array([1.0, 0.0, 1.0])))


def test_lstm_gradients():
    page = hb.blocks("<body><nav><a href=x>Home</a></nav><article><h1>T</h1><p>Some text, here.</p></article><footer>© x</footer>")
    other = hb.blocks("<div class='content x'><p>More of it.</p><p>End</p></div>")
    check_gradients(hb.starting_weights(), loss_html, hb.gradients, ([hb.features(page), hb.features(other)], [np.array([0.0, 1, 1, -1]), np.array([1.0, 0])]))


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in QUERIES["op5_toxicity"](spark, sf).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(got) == 10_000 and all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d, r in got.items())
    test = [(got[d].score, got[d].predicted, y) for d, y in labels.items() if got[d].held_out]
    caught = sum(p for _, p, y in test if y) / sum(y for *_, y in test)
    wrong = sum(p for _, p, y in test if not y) / sum(1 - y for *_, y in test)
    assert caught >= 0.9 and wrong <= 0.03  # some rows here are labelled toxic without a toxic word
    assert all(0 <= s <= 1 and p == (s >= 0.3) for s, p, _ in test)


def test_toxicity_edge_rows(spark):
    toxic, calm = "you are a stupid worthless idiot and scum", "the quiet house by the river was old and kind"
    rows = [(k, toxic + f" x{k}" if k % 2 else calm + f" y{k}") for k in range(40)] + [(50, None), (51, ""), (52, " \n "), (53, "calm " * 50_000 + toxic), (53, "calm " * 50_000 + toxic), (54, "###")]
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)] + [(None, 1), (50, 0)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in tx.report(docs, labels).collect()}
    assert got[50].score == got[51].score == got[52].score == 0 and got[53].score > 0.3 and got[1].predicted == 1 and got[2].predicted == 0
    assert {r.score for r in tx.report(docs, labels.limit(0)).collect()} == {0.0}
    assert tx.report(docs.limit(0), labels).count() == 0


def test_blocks():
    page = "<head><title>x</title></head><body><script>if (a<b) '</p>'</script><!-- c --><p>a &amp; b&nbsp;\n c<b>d</b><br>e<p>f<ul><li>g<li>h</ul><p title='>'>i</p><"
    assert [b[1] for b in hb.blocks(page)] == ["a & b cd", "e", "f", "g", "h", "i", "<"]
    assert [b[0][-1] for b in hb.blocks(page)][3:5] == ["li", "li"]


def truth(html):
    return " ".join(text for path, text, _ in hb.blocks(html) if hb.stated_label(path) == 1)


def test_extraction_of_unseen_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    got = QUERIES["op6_html_extraction"](spark, "/root/testdata/sf0.1").collect()
    html = {r.page_id: r.html for r in pages.collect()}
    assert sum(r.text == truth(html[r.page_id]) for r in got) >= 0.99 * len(html) == 0.99 * len(got)
    assert all(r.n_chars == len(r.text) for r in got)


def test_extraction_of_other_layouts(spark):
    body = [f"The {k}th sentence of this story is long enough, and it ends with a stop." for k in range(4)]
    layouts = [
        '<header><p>Site of things</p></header><div class="content">{}</div><aside class="side-bar"><p>Read more of it here and there, now.</p></aside><footer>me</footer>',
        '<ul class="menu"><li><a href=x>Home</a></ul><main>{}<section class="comments"><p>I liked this story so much, thanks for it.</p></section></main>',
        '<div id="cookie-notice"><p>This site uses cookies, so you must agree to it.</p></div><article>{}</article><form><p>Your name and mail, please.</p></form>',
    ]
    rows = [(k, "u", x.format("".join(f"<p>{b}</p>" for b in body)), "t") for k, x in enumerate(layouts)] + [(10, None, None, None), (11, "u", "", ""), (12, "u", "<<<>>", ""), (13, "u", "<p>" + "word " * 60_000, "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    known = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in hb.extract(pages, hb.train_on(known)).collect()}
    assert all(got[k].text == " ".join(body) for k in range(3)), [got[k].text for k in range(3)]
    assert got[10].text == got[11].text == "" and got[13].n_chars == 60_000 * 5 - 1
    assert hb.extract(pages.limit(0), hb.train_on(pages.limit(0))).count() == 0
