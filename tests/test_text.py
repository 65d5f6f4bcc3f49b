import random

import pytest
from pyspark.sql import functions as F

from foliant.functions import text as X


def values(spark, texts, make):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(make(F.col("t"))).collect()]


def test_tokens_follow_python_split(spark):
    texts = ["", " ", "a b", "a b c", "x\x1cy\x0bz", "\n a \t b \r\n", None]
    assert values(spark, texts, X.count_tokens) == [len((t or "").split()) for t in texts]
    assert values(spark, texts[:-1], X.words) == [t.split() for t in texts[:-1]]


def test_sentences(spark):
    texts = ["One. Two. three. Four", "A.B. C", "End.", " . ", "", "Dr. \n Who went. Home."]
    assert values(spark, texts, X.split_sentences) == [
        ["One.", "Two. three.", "Four"],
        ["A.B.", "C"],
        ["End."],
        ["."],
        [],
        ["Dr.", "Who went.", "Home."],
    ]


def test_word_windows(spark):
    text = " ".join(str(i) for i in range(11))
    assert values(spark, [text, "a b"], lambda c: X.word_windows(c, 5, 2)) == [
        ["0 1 2 3 4", "3 4 5 6 7", "6 7 8 9 10"],
        ["a b"],
    ]
    with pytest.raises(ValueError):
        X.word_windows(F.lit("x"), 5, 5)


def test_jaccard(spark):
    pairs = [("abcd", "abcd"), ("abcd", "bcde"), ("ab", "abc"), ("ABC ", "abc"), ("a😀bc", "a😀bd")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [r[0] for r in df.select(X.trigram_jaccard(F.col("a"), F.col("b"))).collect()]

    def grams(t):
        t = t.lower().strip()
        return {t[i : i + 3] for i in range(len(t) - 2)}

    want = [len(grams(a) & grams(b)) / len(grams(a) | grams(b)) if grams(a) and grams(b) else 0.0 for a, b in pairs]
    assert got == pytest.approx(want)


def test_code_and_concepts(spark):
    code = ["```x", "~~~", "a => b", "CLASS X", "plain", "a\n    b\n    c\nd", "a\n\tb\nc", "a\n\tb\nc\nd"]
    assert values(spark, code, X.contains_code) == [True, True, True, True, False, True, False, False]
    concepts = ["the theory", "Why? Because.", "conceptual theory", "meaningful abstraction"]
    assert values(spark, concepts, X.is_conceptual) == [False, True, True, True]


def test_references_need_word_bounds(spark):
    texts = ["What about it?", "italic thesis", "Explain MORE", "she", "the", "also-ran"]
    assert values(spark, texts, X.has_reference) == [True, False, True, True, False, True]


def test_sizes(spark):
    sizes = [0, 1023, 1024, 1536, 5 * 1024**2, 3 * 1024**4]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "i int, s long")
    got = [r[0] for r in df.orderBy("i").select(X.format_size(F.col("s"))).collect()]
    assert got == ["0.0 B", "1023.0 B", "1.0 KB", "1.5 KB", "5.0 MB", "3.0 TB"]


def test_tokens_of_random_texts(spark):
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("aA .\n é\x0b\u2003") for _ in range(rnd.randint(0, 30))) for _ in range(500)]
    assert values(spark, texts, X.count_tokens) == [len(t.split()) for t in texts]
