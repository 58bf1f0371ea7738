"""Token counts, quality rules and packing against brute force and the public libraries."""

import random
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer
from tokenizers.models import Unigram

from drawloom.llm import packing, quality, tokens
from drawloom.llm.catalog import QUERIES

MODEL = public_tokenizers.path("piece_bpe_32k.model")
BPE = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
EDGE = [(1, None), (2, ""), (3, "a"), (3, "a"), (4, " "), (5, "  two  spaces \n\n x "), (6, "漢字 😀 <|endoftext|> don't"), (7, "word " * 6000), (8, "x" * 5000), (None, "no id"), (9, "▁ ▁▁a ▁")]


def edge(spark, rows=EDGE):
    return spark.createDataFrame([(i, t, "en", "s", 7) for i, t in rows], "doc_id long, text string, n_words string, kept string, start long")


def noise(n, seed=5):
    rng = random.Random(seed)
    bits = ["a", "b ", "  ", "\n", " \n", "é", "漢", "😀", "'s", "don't", "\xa0", "\x1c", "1", "!", " x", "\t", " the", "ing", "▁"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 120))) for _ in range(n)]


@pytest.mark.parametrize("byte_fallback", [True, False])
def test_counts_equal_the_unigram_model(byte_fallback):
    vocabulary = tokens.read_vocabulary(MODEL)
    counter = tokens.Counter(vocabulary, byte_fallback)
    pieces = [("<unk>", 0.0), *vocabulary, *([(f"<0x{i:02X}>", 0.0) for i in range(256)] if byte_fallback else [])]
    model = Unigram(pieces, 0, byte_fallback)
    for text in noise(400):
        assert counter.count(text)[0] == (len(model.tokenize("▁" + text.replace(" ", "▁"))) if text else 0), text


def test_ties_prefer_the_earliest_start():
    vocabulary = [("▁", -1.0), ("a", -1.0), ("aa", -2.0), ("b", -1.0), ("ab", -2.0), ("aab", -3.0)]
    counter = tokens.Counter(vocabulary)
    assert counter.count("aab") == (2, 0, -4.0)  # one piece for the word, one for the space
    assert tokens.Counter([("a▁b", -1.0), ("a", -1.0), ("b", -1.0), ("▁", -1.0)]).count("a b") == (2, 0, -2.0)


def test_token_counts_of_edge_rows(spark):
    rows = {r.doc_id: r for r in tokens.count_tokens(edge(spark), MODEL).collect()}
    assert rows[1].n_pieces == rows[2].n_pieces == 0 and rows[3].n_pieces == 1 and rows[7].n_chars == 30000
    assert tokens.count_tokens(edge(spark, []), MODEL).count() == 0


def brute_repeat(words, window=5):
    places = defaultdict(list)
    for k in range(len(words) - window + 1):
        places[tuple(words[k : k + window])].append(k)
    return len({j for at in places.values() if len(at) > 1 for k in at for j in range(k, k + window)})


def test_repeated_words_equal_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        words = [rng.choice("abc").encode() for _ in range(rng.randint(0, 40))]
        assert quality.repeated_words(words) == brute_repeat(words)
    words = [str(rng.randint(0, 20_000)).encode() for _ in range(30_000)]
    words += words[:9]
    assert quality.repeated_words(words) == brute_repeat(words)


def test_ledger_policies_and_ablation(spark):
    clean = " ".join(f"w{k}" for k in range(60))
    rows = [*EDGE, (20, clean), (21, "a b c\na b c\n \n\n"), (22, " ".join(f"x{k}###" for k in range(20)))]
    ledger = quality.ledger(edge(spark, rows))
    by = {r.doc_id: r for r in quality.apply_policy(ledger).collect()}
    assert by[20].kept and not by[20].base_failed
    assert by[21].n_dup_lines == 1 and by[21].n_words == 6 and by[21].word_chars == 6
    assert by[22].n_symbols == 60 and not by[22].base_failed and not by[22].kept
    assert by[1].n_words == 0 and by[1].base_failed and by[7].base_failed
    table = {r.rule: r for r in quality.ablation(ledger, "v3_strict").collect()}
    bits = [r.failed_bits for r in ledger.collect()]
    for rule, bit in quality.BIT.items():
        assert table[rule].n_failed == sum(bool(b & bit) for b in bits) and table[rule].n_alone == sum(b == bit for b in bits)
    assert quality.ledger(edge(spark, [])).count() == 0
    active = [b & quality.POLICIES["v2_default"] for b in bits]
    for r in quality.report(edge(spark, rows)).collect():
        mine = r.failed_bits & quality.POLICIES["v2_default"]
        alone = [name for name, bit in quality.BIT.items() if bit == mine]
        assert r.sole_rule == (alone[0] if alone else None)
        assert r.sole_rule_docs == (active.count(mine) if alone else None)
        assert r.kept == (mine == 0) and r.base_failed == (r.failed_bits & quality.BASE != 0)
        assert (r.kept_v1_base, r.kept_v2_default, r.kept_v3_strict) == (not r.base_failed, r.kept, r.failed_bits == 0)
    assert quality.report(edge(spark, [])).count() == 0


def check_packing(pieces, docs):
    """Every id in exactly one piece, gapless sequences of powers of two, right checksums."""
    model = Tokenizer.from_file(BPE)
    model.encode_special_tokens = True
    truth = defaultdict(list)
    for doc_id, text in docs:
        truth[doc_id].append([*model.encode(text or "", add_special_tokens=False).ids, 1])
    sequences, by_doc = defaultdict(list), defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append(p)
        by_doc[p.doc_id].append(p)
    for parts in sequences.values():
        parts.sort(key=lambda p: p.offset)
        at = 0
        for p in parts:
            assert p.offset == at and p.length > 0
            at += p.length
        assert at == parts[0].sequence_tokens <= 2048 and at & (at - 1) == 0
    for doc_id, copies in truth.items():
        assert sum(p.length for p in by_doc[doc_id]) == sum(map(len, copies))
        if len(copies) == 1:
            at = 0
            for p in sorted(by_doc[doc_id], key=lambda p: p.start):
                ids = copies[0][p.start : p.start + p.length]
                assert p.start == at and p.doc_tokens == len(copies[0])
                assert p.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
                at += p.length
    assert set(by_doc) == set(truth)


def test_packing_edge_rows(spark):
    rows = [*EDGE, *((100 + k, t) for k, t in enumerate(noise(200)))]
    check_packing(packing.pack(edge(spark, rows).coalesce(2), BPE, RANKS, block_tokens=3000).collect(), rows)
    assert packing.pack(edge(spark, []), BPE, RANKS).count() == 0


def test_packing_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    pieces = QUERIES["op10_packing"](spark, "/root/testdata/sf0.001").collect()
    check_packing(pieces, [(d.doc_id, d.text) for d in docs])
    steps = defaultdict(dict)
    for p in pieces:
        steps[p.step_group][p.sequence_id] = p.sequence_tokens
    assert max(sum(s.values()) for s in steps.values()) <= packing.STEP_TOKENS
