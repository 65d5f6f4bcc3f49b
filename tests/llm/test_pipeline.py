"""The corpus pipeline against its stages in plain Python."""

import hashlib
import os
import re

import duckdb
import numpy as np
import public_tokenizers as P
import regex
import tiktoken

import corpus_pipeline
from foliant.llm.bpe import Ranks

from . import brute

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def redacted(t):
    spans = [(m.start(), m.end()) for m in brute.ASSIGN.finditer(t) if len(m[2]) >= 8]
    spans += [m.span() for m in re.finditer(r"AKIA[A-Z0-9]{12,}|[0-9a-f]{32,}", t)]
    out, at = "", 0
    for s, e in sorted(spans):
        if s >= at:
            out += t[at:s] + "[SECRET]"
        at = max(at, e)
    return out + t[at:]


def test_pipeline(spark):
    con = duckdb.connect()
    docs = con.execute(f"SELECT doc_id, text FROM '{SF_DIR}/documents.parquet' ORDER BY 1").fetchall()
    items = con.execute(f"SELECT item_id, text FROM '{SF_DIR}/benchmark.parquet'").fetchall()
    docs = [r for r in docs if r[1] and regex.search(r"\p{L}", r[1])]
    docs = [r for r, (d, c) in zip(docs, brute.similar_groups(docs, 5, 80), strict=True) if d == c]
    docs = [r for r, c in zip(docs, brute.contamination(docs, items), strict=True) if not c[5]]
    ranks = Ranks(P.path("byte_bpe_multi_50k.tiktoken")).whole
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for d, t in docs:
        t = redacted(t)
        ids = lib.encode_ordinary(t)
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), brute.sha(t)))
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, SF_DIR).collect())
    assert got == sorted(want) and len(corpus_pipeline.STAGES) == 5
