"""The Merkle manifest against a tree built node by node."""

import zlib

import pytest
from pyspark.sql import functions as F

from foliant.llm import manifest, queries

from .brute import sha
from .test_operators import CLASHING, DOCS, same

SOURCES = ["a", None, "b", "Z", "ä", ""]


def leaf(row):
    def one(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    return sha("".join(map(one, row)))


def climb(nodes):
    """Root of a list of nodes, and per node the siblings on the way up as (left, right)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for p, own in enumerate(at):
            run = nodes[own // 3 * 3 : own // 3 * 3 + 3]
            paths[p].append(("".join(run[: own % 3]), "".join(run[own % 3 + 1 :])))
            at[p] = own // 3
        nodes = [sha("".join(nodes[i : i + 3])) for i in range(0, len(nodes), 3)]
    return nodes[0], paths


def brute(rows):
    """rows of (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    own = {}
    for s in names:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        own[s] = climb([leaf(r) for r in groups[s]])
    root, upper = climb([own[s][0] for s in names])
    out = []
    for s, above in zip(names, upper, strict=True):
        for r, path in zip(groups[s], own[s][1], strict=True):
            path = path + above
            changed = r
            if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                changed = (*r[:4], r[4].replace("\n", ""))
            h = leaf(changed)
            for a, b in path:
                h = sha(a + h + b)
            out.append((r[0], leaf(r), own[s][0], root, sha("".join(a + b for a, b in path)), h, h == root))
    return out


def digests(docs):
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    changed = F.when(even, F.translate("text", "\n", "")).otherwise(F.col("text"))
    rows = manifest.verify(manifest.manifest(docs, changed))
    return rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()


def test_awkward_rows(spark):
    rows = [
        (d, SOURCES[i % 6], "en" if i % 3 else None, None if i % 4 == 0 else i, t) for i, (d, t) in enumerate(DOCS)
    ]
    rows += rows[:2]
    extra = ", group string, block long, pos long, path string"
    docs = spark.createDataFrame(
        [(*r, "i", 1, 2, 3, "b", "n", "m", 4, "g", 1, 2, "p") for r in rows],
        f"doc_id long, source string, lang string, n_chars long, text string, {CLASHING}{extra}",
    )
    same(digests(docs), brute(rows))
    assert digests(docs.limit(0)) == []
    plain = manifest.verify(manifest.manifest(docs)).select("verified").distinct().collect()
    assert [r.verified for r in plain] == [True]  # nothing was changed


@pytest.mark.parametrize("depth", [1, 2])
def test_many_tiers_and_a_hot_source(spark, monkeypatch, depth):
    monkeypatch.setattr(manifest, "DEPTH", depth)
    monkeypatch.setattr(manifest, "BLOCK", 3**depth)
    rows = [(i, "hot" if i % 3 else f"s{i}", "en", i, f"line\n{i}") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    same(digests(docs), brute(rows))


def test_one_document(spark):
    row = (7, "a", "en", 1, "x")
    docs = spark.createDataFrame([row], "doc_id long, source string, lang string, n_chars long, text string")
    (got,) = digests(docs)
    assert got.leaf == got.subroot == got.root == got.folded_root == leaf(row) and got.proof_sha256 == sha("")


def test_query_against_the_tree(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text")
    got = queries.op11_merkle_manifest(spark, sf).collect()
    same(got, brute([tuple(r) for r in docs.collect()]))
    assert {r.verified for r in got} == {True, False}
