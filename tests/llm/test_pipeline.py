"""The pipeline stage by stage against the operators' brute-force versions."""

from test_line_chunks import brute as brute_lines
from test_ngram_join import brute as brute_join
from test_text_counts import check_packing
from test_winnowing import brute as brute_windows

import corpus_pipeline as cp
from drawloom.llm import packing, quality
from drawloom.llm.catalog import QUERIES
from drawloom.llm.common import public_tokenizer

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = rows_of(docs)
    seen = []
    for name, stage in cp.STAGES[:-1]:
        before, docs = left, stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        left = rows_of(docs)
        listed = sorted(before.items())
        if name == "quality_rules":
            truth = {d: t for d, t in listed if quality.measure(t)[-1] & quality.POLICIES["v2_default"] == 0}
        elif name == "line_dedup":
            truth = {d: t for d, t, gone in brute_lines(listed) if t or not gone}
        elif name == "ngram_jaccard_join":
            truth = {d: before[d] for d, _, c in brute_join(listed) if c == d}
        else:
            truth = {d: before[d] for d, n, h, _ in brute_windows(listed, items) if not (h > 0 and 20 * h >= n)}
        assert left == truth, name
        assert all(r.n_chars == len(r.text) for r in docs.collect())
        seen.append(len(left))
    check_packing(cp.STAGES[-1][1](spark, docs, SF).collect(), list(left.items()))
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "packing"]


def test_query_and_edges(spark):
    assert QUERIES["pipeline"] is cp.run
    text = " ".join(f"word{k}" for k in range(30))
    rows = [(1, text), (1, text), (2, text + " more"), (3, None), (4, ""), (None, " ".join(f"other{k}" for k in range(30)))]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, n_lines string")
    for _, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns[-1] == "n_lines" and {r.n_lines for r in docs.collect()} == {"x"}
    assert sorted((r.doc_id for r in docs.collect()), key=str) == [1, None]
    for _, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_packing_loads_the_reference_tokenizer_only_for_texts_that_need_it():
    worker = packing.Encoder(public_tokenizer("byte_bpe_50k.json"), public_tokenizer("byte_bpe_50k.tiktoken"))
    texts = [" ".join(f"w{k}" for k in range(packing.MEMO + 1000)), "plain words of ünusual length " * 9]
    plain = worker.batch(texts)
    assert "slow" not in vars(worker) and len(worker.memo) <= 50_000
    assert [ids.tolist() for ids in plain] == [worker.slow.encode(t, add_special_tokens=False).ids for t in texts]
    assert worker.batch(["日本語 テキスト"])[0].tolist() == worker.slow.encode("日本語 テキスト", add_special_tokens=False).ids
