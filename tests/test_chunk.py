import random
import re

import pytest
from hypothesis import given
from hypothesis import strategies as st

from foliant.operators import chunk as C

ITEM = re.compile(r"^\s*(?:[-*•]|\d+\.)\s+")


def model_blocks(text):
    """The block rules as stated: what a line starts decides, and each kind has its own end."""
    lines, out, i = text.split("\n"), [], 0

    def kind(line):
        if line.strip().startswith("|"):
            return "table"
        if line.strip().startswith("```"):
            return "code"
        return "list" if ITEM.match(line) else "text"

    while i < len(lines):
        k, j = kind(lines[i]), i + 1
        if k == "table":
            while j < len(lines) and "|" in lines[j]:
                j += 1
        elif k == "code":
            while j < len(lines) and kind(lines[j]) != "code":
                j += 1
            j = min(j + 1, len(lines))
        elif k == "list":
            while j < len(lines):
                blank_then_item = not lines[j].strip() and j + 1 < len(lines) and ITEM.match(lines[j + 1])
                if not (ITEM.match(lines[j]) or blank_then_item):
                    break
                j += 1
        else:
            while j < len(lines) and kind(lines[j]) == "text":
                j += 1
        content = "\n".join(lines[i:j])
        content = content.strip() if k == "text" else content
        if content:
            out.append((k, content))
        i = j
    return out


def run_blocks(spark, texts):
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "doc_id string, text string")
    found = {}
    for r in C.segment_blocks(df).orderBy("doc_id", "block").collect():
        found.setdefault(int(r.doc_id), []).append((r.type, r.content))
    return [found.get(i, []) for i in range(len(texts))]


def test_blocks_by_hand(spark):
    text = "Intro\nmore\n| a | b |\n|---|\nx | y\nText.\n```py\ncode | x\n- no item\n```\n- one\n\n- two\n\nEnd\n1. n\n```\nopen"
    assert run_blocks(spark, [text])[0] == [
        ("text", "Intro\nmore"),
        ("table", "| a | b |\n|---|\nx | y"),
        ("text", "Text."),
        ("code", "```py\ncode | x\n- no item\n```"),
        ("list", "- one\n\n- two"),
        ("text", "End"),
        ("list", "1. n"),
        ("code", "```\nopen"),
    ]


LINES = ["", " ", "a b", "a | b", "| t", " |x|", "```", "``` py", "- i", "* i", "2. i", "-no", "• i", "  3.  x"]


def test_blocks_follow_the_rules(spark):
    rnd = random.Random(1)
    texts = ["\n".join(rnd.choice(LINES) for _ in range(rnd.randint(0, 12))) for _ in range(3000)]
    assert [t for t, b in zip(texts, run_blocks(spark, texts)) if b != model_blocks(t)] == []


def test_long_blocks_do_not_overflow_the_regex_stack(spark):
    text = "\n".join(["- item"] * 60000 + ["plain"] * 60000 + ["| a |"] * 60000 + ["```"] + ["x"] * 60000)
    assert [k for k, _ in run_blocks(spark, [text])[0]] == ["list", "text", "table", "code"]


@given(st.lists(st.integers(0, 12), max_size=40), st.integers(1, 10), st.data())
def test_borders(counts, size, data):
    overlap = data.draw(st.integers(0, size - 1))
    out = C.chunk_borders(counts, size, overlap)
    covered = sorted({i for a, b in out for i in range(a, b)})
    assert covered == list(range(len(counts)))  # nothing lost
    for (a, b), nxt in zip(out, [*out[1:], None]):
        total = sum(counts[a:b])
        if counts[a] > size:
            assert b == a + 1
        else:
            assert total <= size + overlap
        if nxt and nxt[0] < b:
            assert sum(counts[nxt[0] : b]) <= overlap
            assert nxt[0] > a or nxt[1] > b


def test_chunk_documents(spark):
    words = " ".join(f"w{i}" for i in range(12))
    items = "\n".join(f"- item {i} x y." for i in range(9))
    docs = [
        ("t", "| a |\n| b |\nSome text. More text."),
        ("l", "- a b\n- c d"),
        ("long", words),
        ("items", items),
        ("blank", "  \n "),
    ]
    df = spark.createDataFrame(docs, "doc_id string, text string")
    rows = C.chunk_documents(df, size=10, overlap=2).orderBy("doc_id", "position").collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    assert "blank" not in by_doc
    assert [(r.structure_type, r.text) for r in by_doc["t"]] == [
        ("table", "| a |\n| b |"),
        ("text", "Some text. More text."),
    ]
    assert by_doc["t"][0].has_table and by_doc["t"][0].sentence_count is None
    assert by_doc["t"][1].sentence_count == 2
    assert [r.text for r in by_doc["l"]] == ["- a b\n- c d"] and by_doc["l"][0].has_list
    assert [r.tokens for r in by_doc["long"]] == [10, 4]
    assert len(by_doc["items"]) > 1 and all(r.has_list for r in by_doc["items"])
    assert [r.position for r in by_doc["items"]] == list(range(len(by_doc["items"])))
    assert rows[0].chunk_id == f"{rows[0].doc_id}_chunk_{rows[0].position}"
    with pytest.raises(ValueError):
        C.chunk_documents(df, size=5, overlap=5)


@given(st.text(alphabet="ab \n", max_size=300), st.integers(5, 40), st.integers(0, 4))
def test_character_pieces(text, size, overlap):
    pieces = C.split_recursively(text, size, overlap)
    assert all(0 < len(p) <= size and p == p.strip() for p in pieces)
    assert "".join("".join(pieces).split()).count("a") >= text.count("a")


def test_character_pieces_by_hand():
    assert C.split_recursively("aaa bbb ccc", 7, 3) == ["aaa bbb", "ccc"]
    assert C.split_recursively("aaa bbb ccc", 8, 4) == ["aaa bbb", "bbb ccc"]
    assert C.split_recursively("one\n\ntwo", 20, 0) == ["one\n\ntwo"]
    assert C.split_recursively("abcdefghij", 4, 1) == ["abcd", "defg", "ghij"]


def test_pieces_leave_a_worker_before_its_batch_ends(spark, monkeypatch):
    monkeypatch.setattr(C, "SPLIT_CHARS", 1000)
    texts = [(i, "word " * (i * 40)) for i in range(30)] + [(98, None), (99, "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    found = C.recursive_char_split(docs, 200, 20)
    assert "ArrowEvalPython" not in found._jdf.queryExecution().executedPlan().toString()  # that holds a batch's pieces
    got = {}
    for r in found.collect():
        got.setdefault(r.doc_id, {})[r.piece] = r.text
    want = {i: dict(enumerate(C.split_recursively(t, 200, 20))) for i, t in texts if t}
    assert got == want
