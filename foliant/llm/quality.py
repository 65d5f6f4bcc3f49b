"""Quality rules with risk-controlled thresholds, in DataFrame operations only.

Each rule rejects documents whose measure exceeds a cutoff. Labelled documents are split by hash:
one half chooses, the other certifies. Per stratum and rule the choosing half proposes the cutoff
that rejects most bad and fewest good documents, if any is worth taking and keeps its false
rejections within ``ALLOWED``. It also puts the rules of a stratum in order, those with the fewest
false rejections first. The holdout certifies the longest beginning of that order whose rules
together have an exact binomial tail P[Bin(n, ALLOWED) <= k] of at most ``DELTA / strata``: ``n``
counts its good documents, ``k`` those that any of the rules rejects, each once, and ``strata``
those with a proposal (Bonferroni). ``k`` never falls along the order, so the first beginning
that loses too much is passed by mistake with at most that probability, and a longer one only if
it is passed too. So with probability ``1 - DELTA`` no stratum loses more than ``ALLOWED`` of its
good documents to all rules together; a stratum with too few labels has no cutoff.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import lookup
from ..session import materialise
from .common import bind, whole

# fixed values: white space between words, symbols, and the limits of the base rules
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = "#*$%&|<>"
RUN = 8
MIN_WORDS = 20
MAX_REPEATED = 30

ALLOWED, DELTA = 0.02, 0.05
# the measures in percent, and the cutoffs tried for each
MEASURES = ["symbols", "dup_lines", "repeated", "long_words", "short_words", "caps"]
CUTOFFS = [1, 2, 3, 5, 8, 12, 18, 25, 35, 50, 70, 90]
# bad documents must be rejected this many times as often as good ones
WORTH = 4.0


def split_words(text: Column) -> Column:
    spaced = F.translate(text, SPACES, " " * len(SPACES))
    return F.array_remove(F.split(spaced, " ", -1), "")


def repeated_words(words: Column, run: int = RUN) -> Column:
    """Words that lie in a run of ``run`` words found twice or more.

    The hashes of all runs are sorted with their positions, so equal ones are neighbours; the
    positions of repeated runs, again sorted, each add what the one before does not cover.
    """
    runs = F.transform(
        F.sequence(F.lit(0), F.size(words) - run),
        lambda i: F.struct(F.xxhash64(F.slice(words, i + 1, run)).alias("h"), i.alias("at")),
    )

    def twice(s: Column) -> Column:
        n = F.size(s)
        same = F.zip_with(
            F.slice(s, F.lit(1), n - 1), F.slice(s, F.lit(2), n - 1), lambda a, b: a["h"] == b["h"]
        )
        no = F.array(F.lit(False))
        marked = F.zip_with(
            s,
            F.zip_with(F.concat(no, same), F.concat(same, no), lambda a, b: a | b),
            lambda a, hit: F.when(hit, a["at"]),
        )
        return F.sort_array(F.filter(marked, lambda m: m.isNotNull()))

    def covered(at: Column) -> Column:
        gaps = F.zip_with(
            F.slice(at, F.lit(2), F.size(at) - 1),
            F.slice(at, F.lit(1), F.size(at) - 1),
            lambda b, a: F.least(b - a, F.lit(run)),
        )
        return F.when(F.size(at) == 0, 0).otherwise(
            F.aggregate(gaps, F.lit(run), lambda total, g: total + g)
        )

    def count(r: Column) -> Column:
        # most texts repeat no run and need no sorting
        single = F.size(F.array_distinct(r["h"])) == F.size(r)
        return F.when(single, F.lit(0)).otherwise(bind(bind(F.sort_array(r), twice), covered))

    return F.when(F.size(words) <= run, 0).otherwise(bind(runs, count))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, stratum and the counts of every row of ``docs`` (doc_id, text, lang)."""
    text = whole(F.col("text"))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.translate(x, SPACES, "") != "")
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("stratum"), text.alias("text"))
    values = bind(
        split_words(F.col("text")),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.coalesce(repeated_words(w), F.lit(0)).cast("long").alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: F.length(x) > 20)).alias("long_words"),
            F.size(F.filter(w, lambda x: F.length(x) < 2)).alias("short_words"),
        ),
    )
    t = F.col("text")
    plain = F.length(F.translate(t, SPACES, ""))
    return rows.select(
        "doc_id",
        "stratum",
        plain.cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        bind(lines, lambda x: F.struct(F.size(x).alias("lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dups"))).alias("l"),
        (F.length(t) - F.length(F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).alias("n_caps"),
        values.alias("v"),
    ).select(
        "doc_id", "stratum", "v.n_words", "word_chars", "n_symbols",
        F.col("l.dups").alias("n_dup_lines"), "v.n_repeat_words",
        F.col("l.lines").alias("n_lines"), "n_caps", "v.long_words", "v.short_words",
    )


def percent(part: str, of: str) -> Column:
    return F.when(F.col(of) > 0, 100.0 * F.col(part) / F.col(of)).otherwise(0.0)


def ratios() -> list[Column]:
    return [
        percent("n_symbols", "word_chars").alias("symbols"),
        percent("n_dup_lines", "n_lines").alias("dup_lines"),
        percent("n_repeat_words", "n_words").alias("repeated"),
        percent("long_words", "n_words").alias("long_words"),
        percent("short_words", "n_words").alias("short_words"),
        percent("n_caps", "word_chars").alias("caps"),
    ]


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))


def log_factorial(n: Column) -> Column:
    """ln(n!) by Stirling's series from 16 on, summed below."""
    x = n.cast("double") + 1
    big = (x - 0.5) * F.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x * x * x)
    small = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1)).cast("int")), F.lit(0.0), lambda a, i: a + F.log(i.cast("double")))
    return F.when(n >= 16, big).otherwise(small)


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P[Bin(n, p) <= k] for k below the mean (1 above it): the last term times a falling series."""
    last = (
        log_factorial(n) - log_factorial(k) - log_factorial(n - k)
        + k * math.log(p) + (n - k) * math.log1p(-p)
    )
    odds = (1 - p) / p
    series = F.aggregate(
        F.sequence(F.lit(0), k.cast("int")),
        F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum")),
        lambda a, i: F.struct(
            (a["term"] * (k - i) / (n - k + i + 1) * odds).alias("term"), (a["sum"] + a["term"]).alias("sum")
        ),
        lambda a: a["sum"],
    )
    return F.when(k >= n * p, 1.0).otherwise(F.least(F.exp(last) * series, F.lit(1.0)))


def thresholds(features: DataFrame, labels: DataFrame) -> DataFrame:
    """``stratum``, ``rule``, ``cutoff``: the chosen certified cutoffs.

    Labels join the counts by doc_id; documents that the base rules reject decide nothing. All
    labelled documents count.
    """
    good = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(
        F.min("quality").alias("quality")
    )
    rows = features.where(~base_failed()).select("doc_id", "stratum", *ratios()).join(good, "doc_id")
    rows = rows.withColumn("holdout", F.crc32(F.col("doc_id").cast("string")) % 2 == 0)
    rows = materialise(rows, "labelled")
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("rule"), F.col(m).alias("value")) for m in MEASURES]))
    cells = rows.where("not holdout").select("stratum", "quality", each.alias("c")).select(
        "stratum", "quality", "c.rule", F.explode(F.array(*map(F.lit, CUTOFFS))).alias("cutoff"), "c.value"
    )
    hit, ok = F.col("value") > F.col("cutoff"), F.col("quality") == 1
    count = lambda c: F.count(F.when(c, 1))
    sums = cells.groupBy("stratum", "rule", "cutoff").agg(
        count(ok & hit).alias("good_hit"), count(ok).alias("good"),
        count(~ok & hit).alias("bad_hit"), count(~ok).alias("bad"),
    )
    lost = F.col("good_hit") / F.greatest("good", F.lit(1))
    gain = F.col("bad_hit") / F.greatest("bad", F.lit(1)) - WORTH * lost
    best = (
        sums.withColumn("gain", gain)
        .where((F.col("gain") > 0) & (lost <= ALLOWED))
        .groupBy("stratum", "rule")
        .agg(F.max_by(F.struct("cutoff", "good_hit", "gain"), F.struct("gain", "cutoff")).alias("best"))
        .select("stratum", "rule", "best.*")
    )
    order = Window.partitionBy("stratum").orderBy("good_hit", F.desc("gain"), "rule")
    proposed = materialise(best.select("stratum", "rule", "cutoff", F.row_number().over(order).alias("place")), "cutoffs")
    strata = max(proposed.select("stratum").distinct().count(), 1)

    # of every good holdout document the first rule that rejects it
    limits = proposed.groupBy("stratum").pivot("rule", MEASURES).agg(F.first(F.struct("cutoff", "place")))
    limits = limits.select("stratum", *[F.col(m).alias(f"l_{m}") for m in MEASURES])
    held = lookup(rows.where(F.col("holdout") & ok), limits, ["stratum"], "inner")
    first = F.least(*[F.when(F.col(m) > F.col(f"l_{m}.cutoff"), F.col(f"l_{m}.place")) for m in MEASURES])
    found = held.groupBy("stratum").agg(
        F.count(F.lit(1)).alias("n"), *[count(first <= j).alias(f"k{j}") for j in range(1, len(MEASURES) + 1)]
    )
    ks = F.array(*[F.col(f"k{j}") for j in range(1, len(MEASURES) + 1)])
    tested = proposed.join(found.select("stratum", "n", ks.alias("ks")), "stratum")
    tested = tested.withColumn("k", F.element_at("ks", F.col("place")))
    certified = binomial_tail(F.col("n"), F.col("k"), ALLOWED) <= DELTA / strata
    return tested.where(certified).select("stratum", "rule", "cutoff")


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Judges every row of ``docs`` (doc_id, text, lang) with cutoffs learned from ``labels``.

    Columns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept. ``kept`` is false if the base rules fail or a measure exceeds its stratum's cutoff. The
    stratum is ``lang`` (null: its own). A null text has no words; repeated rows each get their
    row and repeated labels count once, the worse one; other columns are ignored. Without labels
    only the base rules reject.
    """
    features = materialise(measured(docs), "measures")
    limits = thresholds(features, labels).groupBy("stratum").pivot("rule", MEASURES).agg(F.first("cutoff"))
    limits = limits.select("stratum", *[F.col(m).alias(f"max_{m}") for m in MEASURES])
    limits = materialise(limits, "thresholds")
    rows = lookup(features.select("*", *[r.alias(f"p_{m}") for r, m in zip(ratios(), MEASURES, strict=True)]), limits, ["stratum"])
    over = F.lit(False)
    for m in MEASURES:
        over = over | F.coalesce(F.col(f"p_{m}") > F.col(f"max_{m}"), F.lit(False))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), (~base_failed() & ~over).alias("kept"),
    )
