"""Secret scan with multipart credential linking, in DataFrame operations only.

Three strong patterns are reported wherever they match. A weak candidate (a bare mixed token, or
a value given to a key-like name) says little alone: it is reported only when the parts that make
it usable stand near it in the same document. An access identifier must lie within ``SCOPE`` code
points of a bare token; an identifier or an endpoint within that of a named value. Identifiers
and endpoints within the scope of a reported candidate are reported with it.

The parts are joined as intervals: positions are put into bins as wide as the scope, the first
and last part of each kind stand for the bin (the nearest one in a neighbouring bin is always its
first or last), and a candidate meets three bins. A document with a million parts therefore
yields a few rows per candidate, never pairs of parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.running import running_max, running_sum
from ..session import materialise
from .common import bind, keyed, row_key, unused, whole

# fixed values: the base patterns and the least lengths of what they must find
ASSIGN = (
    r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ASSIGN_VALUE = 8
# a run that is long enough is the same match as a run that is measured afterwards
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"

# parts that only count together
IDENT = (
    r"""(?i)\b(?:access_?key(?:_?id)?|key_?id|client_?id|account|user(?:name)?|login)["']?"""
    r"""\x20*[:=]\x20*["']?[A-Za-z0-9._@+-]{3,}"""
)
ENDPOINT = r"""\b[A-Za-z][A-Za-z0-9+.-]{1,15}://[^\s"'<>]{4,}"""
NAMED = r"""(?i)\b(?:key|pwd|pass|credential|auth)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}"""
BARE = (
    r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*[0-9])(?=[A-Z0-9+/_-]*[a-z])(?=[a-z0-9+/_-]*[A-Z])"
    r"[A-Za-z0-9+/_-]{20,}"
)
SCOPE = 200
KINDS = ["assign", "access", "hex", "ident", "named", "bare", "endpoint"]
# code points of a text that are cut together
BLOCK = 1 << 13
SPAN = "array<struct<start:int,kind:int,end:int>>"


def spans_of(text: Column, pattern: str, kind: int, value: tuple[int, int] | None = None) -> Column:
    """Leftmost matches that do not overlap, as (start, kind, end) in code points.

    The text between matches and the matches themselves are measured in turn. ``value`` is a
    group and the least length it must have.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value[0] if value else 0))
    gaps = F.split(text, pattern, -1)
    steps = F.zip_with(
        matches,
        F.arrays_zip(F.slice(gaps, F.lit(1), F.size(matches)).alias("gap"), values.alias("value")),
        lambda m, g: F.struct(
            F.length(g["gap"]).alias("gap"), F.length(m).alias("size"), F.length(g["value"]).alias("value")
        ),
    )

    def placed(s: Column, at: Column) -> Column:
        start = at + s["gap"]
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + s["size"]).alias("end"))
        return F.struct(span.alias("span"), s["value"].alias("value"))

    def spans(of: Column) -> Column:
        before = running_sum(F.transform(of, lambda s: s["gap"] + s["size"]))
        long = F.filter(F.zip_with(of, before, placed), lambda f: f["value"] >= (value[1] if value else 0))
        return F.transform(long, lambda f: f["span"]).cast(SPAN)

    found = bind(steps, spans)
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(SPAN))


def base_spans(text: Column) -> Column:
    """The spans of the three strong patterns."""
    return F.concat(
        spans_of(text, ASSIGN, 0, (2, ASSIGN_VALUE)), spans_of(text, ACCESS, 1), spans_of(text, HEX, 2)
    )


def weak_parts(text: Column) -> Column:
    """Identifiers, weak candidates and endpoints."""
    return F.concat(*[spans_of(text, p, k) for p, k in ((IDENT, 3), (NAMED, 4), (BARE, 5), (ENDPOINT, 6))])


def apart(parts: DataFrame) -> DataFrame:
    """``parts`` (_id, _hash, start, kind, stop) without the weak candidates that overlap a base span."""
    row, base = Window.partitionBy("_id", "_hash"), F.col("kind") < 3
    up_to = row.orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    # from the far end on: a frame that ends with the last row would be read again for every row
    since = row.orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    reach = F.max(F.when(base, F.col("stop"))).over(up_to)
    after = F.min(F.when(base, F.col("start"))).over(since)
    meets = (F.coalesce(reach, F.lit(0)) > F.col("start")) | F.coalesce(after < F.col("stop"), F.lit(False))
    met = F.col("kind").isin(4, 5) & meets
    return parts.withColumn("_met", met).where("not _met").drop("_met")


def near(points: DataFrame, others: DataFrame, scope: int) -> DataFrame:
    """The points whose start lies within ``scope`` of the start of one of the others of their row."""
    key = ["_id", "_hash"]
    bins = others.groupBy(*key, F.floor(F.col("start") / scope).alias("bin")).agg(
        F.min("start").alias("first"), F.max("start").alias("last")
    )
    own = F.floor(F.col("start") / scope)
    spread = points.select("*", F.explode(F.array(own - 1, own, own + 1)).alias("bin"))
    gap = F.least(F.abs(F.col("first") - F.col("start")), F.abs(F.col("last") - F.col("start")))
    close = (F.col("bin") == own) | (gap <= scope)
    return spread.join(bins, [*key, "bin"]).where(close).select(*points.columns).distinct()


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Every row of ``docs`` as (_id, _hash, doc_id, base, added), the last two arrays of spans."""
    text = whole(F.col("text"))
    base = docs.select("doc_id", *row_key(), base_spans(text).alias("base"), text.alias("text"))
    base = materialise(base.withColumn("parts", weak_parts(F.col("text"))).drop("text"), "spans")
    # an access span is an identifier too; a row without a weak candidate links nothing
    every = F.concat("parts", "base")
    parts = base.where(F.exists("parts", lambda s: s["kind"].isin(4, 5)))
    parts = parts.select("_id", "_hash", F.inline(every)).distinct().withColumnRenamed("end", "stop")
    parts = materialise(apart(parts), "parts")
    with_ident = near(parts.where("kind in (4, 5)"), parts.where("kind in (1, 3)"), scope)
    with_endpoint = near(parts.where("kind = 4"), parts.where("kind = 6"), scope)
    linked = materialise(with_ident.union(with_endpoint).distinct(), "linked")
    added = linked.union(near(parts.where("kind in (3, 6)"), linked, scope))
    span = F.struct("start", "kind", F.col("stop").alias("end"))
    added = materialise(added.groupBy("_id", "_hash").agg(F.collect_set(span).alias("added")), "added")
    out = base.drop("parts").join(added, ["_id", "_hash"], "left")
    return out.withColumn("added", F.coalesce("added", F.array().cast(SPAN)))


def spans_text(spans: Column) -> Column:
    """kind:start:end of all spans by start, then kind as listed, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    one = F.transform(
        F.sort_array(spans),
        lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"]),
    )
    return F.array_join(one, ",")


def find_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Per row of ``docs`` (doc_id, text) the secrets found, positions in code points, end exclusive.

    Columns doc_id, n_assign, n_access, n_hex, base_sha256 (of the base spans as text) and spans
    (base and linked ones as text, see ``KINDS``). Spans of different kinds may overlap. A null
    text counts as empty and has none; repeated rows each get their row; other columns are
    ignored; no rows give no rows.
    """

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return scan(docs, scope).select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"),
        spans_text(F.concat("base", "added")).alias("spans"),
    )


def without(text: Column, cuts: Column, mark: str) -> Column:
    """The text with ``mark`` for each run of overlapping spans; ``cuts`` are sorted by start.

    The text is cut into blocks once, so that a piece is found in steps of its block alone.
    """
    size = F.floor(F.greatest(F.length(text) - 1, F.lit(0)) / BLOCK).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), size), lambda b: F.substring(text, b * BLOCK + 1, F.lit(BLOCK)))

    def piece(of: Column, start: Column, end: Column) -> Column:
        first, last = F.floor(start / BLOCK).cast("int"), F.floor(end / BLOCK).cast("int")
        skip, rest = start - first * BLOCK, end - last * BLOCK
        inner = F.array_join(F.slice(of, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
        head = F.substring(F.get(of, first), skip + 1, F.lit(BLOCK))
        tail = F.substring(F.coalesce(F.get(of, last), F.lit("")), F.lit(1), rest)
        short = F.substring(F.coalesce(F.get(of, first), F.lit("")), skip + 1, end - start)
        return F.when(first == last, short).otherwise(F.concat(head, inner, tail))

    # where all spans before one, and all spans, have ended
    ended = running_max(F.transform(cuts, lambda s: s["end"]))
    pairs = F.zip_with(cuts, ended, lambda s, at: F.struct(at.alias("at"), s["start"].alias("start")))
    fresh = F.filter(pairs, lambda p: p["start"] >= p["at"])
    stop = F.array_max(F.transform(cuts, lambda s: s["end"]))

    def rebuilt(of: Column) -> Column:
        kept = F.transform(fresh, lambda p: F.concat(piece(of, p["at"], p["start"]), F.lit(mark)))
        return F.concat(F.array_join(kept, ""), piece(of, stop, F.length(text)))

    return bind(blocks, rebuilt)


def redact(docs: DataFrame, mark: str = "[SECRET]", scope: int = SCOPE) -> DataFrame:
    """``docs`` with every secret span (not the linked identifiers and endpoints) replaced by ``mark``.

    Overlapping spans become one mark. ``n_chars`` follows the new text where that column exists;
    rows without a secret stay as they are, null texts included.
    """
    found = scan(docs, scope)
    secret = F.filter(F.concat("base", "added"), lambda s: s["kind"].isin(0, 1, 2, 4, 5))
    cuts = unused(docs, "_cuts")
    found = found.select(
        F.col("_id").alias(f"{cuts}_id"), F.col("_hash").alias(f"{cuts}_hash"), F.sort_array(secret).alias(cuts)
    ).where(F.size(cuts) > 0)
    found = materialise(found.dropDuplicates(), "secrets")
    rows, key, own_id, own_hash = keyed(docs)
    rows = rows.join(found, (own_id == found[f"{cuts}_id"]) & (own_hash == found[f"{cuts}_hash"]), "left")

    shorter = without(F.col("text"), F.col(cuts), mark)
    has = F.col(cuts).isNotNull()
    rows = rows.withColumn("text", F.when(has, shorter).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        size = F.when(has, F.length("text")).otherwise(F.col("n_chars"))
        rows = rows.withColumn("n_chars", size.cast(dict(docs.dtypes)["n_chars"]))
    return rows.select(*docs.columns)
