"""Secret scans against plain regular expressions, and the battery on known strings."""

import base64
import hashlib
import random
import re

from drawloom.llm import secrets
from drawloom.llm.catalog import QUERIES

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS, HEX = re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")


def brute(docs):
    out = []
    for doc, text in docs:
        text = text or ""
        spans = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
        spans += [(m.start(), 1, m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 16]
        spans += [(m.start(), 2, m.end(), "hex") for m in HEX.finditer(text) if len(m[0]) >= 32]
        digest = hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans)).encode()).hexdigest()
        out.append((doc, *(sum(k == kind for *_, k in spans) for kind in ("assign", "access", "hex")), digest))
    return sorted(out, key=repr)


def run(spark, docs):
    df = spark.createDataFrame([(i, t, "s", 1) for i, t in docs], "doc_id long, text string, spans string, k1 int").repartition(3)
    return secrets.report(df).collect()


def test_base_spans(spark):
    rng = random.Random(6)
    bits = ["token", "TOKEN", "Api_Key", "apikey", "passwd", ' = "', ":", "'", " ", "\n", "é😀", "abcdefgh", "AKIA", "AKIAABCDEFGH1234", "0123456789abcdef", "secret=", "x.y-z", "="]
    docs = [(k, "".join(rng.choice(bits) for _ in range(rng.randint(0, 60)))) for k in range(400)]
    docs += [(500, None), (501, ""), (None, "token=abcdefgh"), (1, docs[1][1]), (502, "token = abcdefgh " * 3000), (503, "token=secret= abcdefgh")]
    assert sorted(((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in run(spark, docs)), key=repr) == brute(docs)
    assert run(spark, []) == []


def test_random_strings_are_told_from_ordinary_ones(spark):
    rng = random.Random(1)
    secret = [base64.b64encode(rng.randbytes(30)).decode() for _ in range(150)] + [rng.randbytes(16).hex().upper() for _ in range(150)]
    plain = ["internationalisation_of_things", "path/to/some/long/file-name", "Donaudampfschifffahrtsgesellschaft", "0" * 40, "0123456789" * 4, "abababababababababab1", "aaaaaaaaaaaaaaaaaaaaaaaa1111111111", "AbAbAbAbAbAbAbAbAbAbAbAbAbAbAb12"]
    docs = [(k, f"é see {t} end") for k, t in enumerate(secret + plain)]
    found = {r.doc_id: r.spans for r in run(spark, docs)}
    caught = sum("random:6:" in found[k] for k in range(len(secret)))
    assert caught >= 0.9 * len(secret)
    assert not any("random" in found[len(secret) + k] for k in range(len(plain)))
    assert f"random:6:{6 + len(secret[0])}" in found[0] or caught < len(secret)


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    got = QUERIES["op1_secret_scans"](spark, "/root/testdata/sf0.01").collect()
    assert sorted(((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got), key=repr) == brute(docs)
