"""Branches that the driver's tables do not reach, on hand-made rows."""

import json
import random

import pytest
from pyspark.sql import functions as F

from foliant.operators import catalog as G
from foliant.operators import chats as T
from foliant.operators import embed as M
from foliant.operators import extract as E
from foliant.operators import messages as MS
from foliant.operators import telemetry as O
from foliant.operators import validate as V
from foliant.functions import lexicon as L
from foliant.functions.substrings import find_substrings
from foliant.operators.spacing import spaced
from foliant.session import shared_dir
from foliant.sources import files as SF
from foliant.sources import json_logs as SJ
from foliant.sources import tables as ST
from foliant.streaming import index as SI
from foliant.streaming import keyed as SK
from foliant.streaming import states as SS
from foliant.streaming.runner import latest_per_key, replay, run_to_table


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(make(F.col("v"))).first()[0]


# --- sources ------------------------------------------------------------------------------


def test_files_from_a_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "A.TXT").write_bytes(b"one two\nthree \xff\xfe")
    (tmp_path / "sub" / "b.pdf").write_bytes(b"%PDF")
    (tmp_path / ".hidden").write_text("x")
    found = {r.name: (r.ext, r["size"]) for r in SF.scan_files(spark, str(tmp_path)).collect()}
    assert found == {"A.TXT": (".txt", 16), "b.pdf": (".pdf", 4)}
    (doc,) = SF.read_text_docs(spark, str(tmp_path)).collect()
    assert (doc.line_count, doc.word_count) == (2, 4) and doc.text.startswith("one two\nthree �")


def test_chat_files_and_catalog(spark, tmp_path):
    chats = tmp_path / "courses" / "c1" / "chats"
    chats.mkdir(parents=True)
    body = {"messages": [{"content": "hi", "sender": "human", "citations": [], "documentIds": ["d"]},
                         {"content": "yo", "sender": "bot", "timestamp": "2024-01-01T00:00:00Z",
                          "citations": [{"text": "a b", "documentTitle": "T"}]}]}
    (chats / "k9.json").write_text(json.dumps(body, indent=1))
    rows = SJ.read_chats(spark, str(tmp_path)).orderBy("seq").collect()
    assert [(r.course_id, r.chat_id, r.seq, r.sender, r.content) for r in rows] == [
        ("c1", "k9", 0, "human", "hi"), ("c1", "k9", 1, "bot", "yo")]
    assert [(r.citations, r.timestamp) for r in rows] == [
        ("[]", None), ('[{"text":"a b","documentTitle":"T"}]', "2024-01-01T00:00:00Z")]
    other = tmp_path / "more" / "courses" / "c2"
    other.mkdir(parents=True)
    (other / "chats.json").write_text(json.dumps({"chats": [
        {"id": "a", "title": "T", "latestActivity": "2024-01-01T00:00:00Z"},
        {"id": "b", "title": "U", "latestActivity": "2024-01-02T00:00:00Z", "chatType": "general", "documentIds": ["x"]}]}))
    got = {r.chat_id: r for r in SJ.read_chat_catalog(spark, str(tmp_path / "more")).collect()}
    assert got["a"].chat_type == "document-based" and got["a"].document_ids == []
    assert got["b"].chat_type == "general" and got["b"].course_id == "c2"


def test_logs_and_tokens(spark):
    lines = ['{"timestamp":"t","level":"INFO","line":3,"extra":1}', "", "not json"]
    (row,) = SJ.parse_json_logs(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert row.line == 3 and row.extras == {"extra": "1"} and row.exception is None
    lines = ['{"message":{"content":"a"},"response":"z"}', '{"message":{"content":""},"response":"b"}', "{oops", " ", '{"done":true}']
    df = SJ.parse_token_stream(spark.createDataFrame(list(enumerate(lines)), "seq int, line string"))
    assert [(r.seq, r.token, r.done) for r in df.orderBy("seq").collect()] == [(0, "a", False), (1, "b", False), (4, None, True)]


def test_chunk_table_replaces_on_reingest(spark):
    chunks = spark.createDataFrame([("c0", "d", 0, "one"), ("c1", "d", 1, "two"), ("c2", "e", 0, "x")],
                                   "chunk_id string, doc_id string, position int, text string")
    vectors = spark.createDataFrame([("c0", [1.0]), ("c1", None), ("c2", [2.0])], "chunk_id string, embedding array<double>")
    path = shared_dir(spark, "test-chunks")
    ST.write_chunks(ST.stored_chunks(chunks, vectors), path, 1)
    ST.write_chunks(ST.stored_chunks(chunks.where("doc_id = 'd'"), vectors), path, 2)
    rows = ST.read_chunks(spark, path).collect()
    assert sorted((r.doc_id, r.embedding[0]) for r in rows) == [("d", 1.0), ("e", 2.0)]
    assert all(r.chunk_id.startswith(f"{r.doc_id}_chunk_{r.position}_") for r in rows)


# --- validation ---------------------------------------------------------------------------


def test_suspicious_content_anywhere(spark):
    pad = "é" * 5120
    check = lambda t: one(spark, bytearray(t.encode()), V.suspicious_content, "binary")
    assert check("x <script>") and check("y" * 10233 + "<script")
    assert check(pad + "<script") and check("y" * 2_000_000 + "<script") and not check("<SCRIPT")


def test_titles_and_types(spark):
    assert one(spark, "/a/Report.PDF", V.title_of) == "Report.PDF"
    assert one(spark, "/a/report.v2.pdf", V.title_of) == "report.v2"
    assert one(spark, ".profile", V.extension) == ""
    assert one(spark, ".md", V.doc_type) == "other"


# --- extraction ---------------------------------------------------------------------------


def test_html(spark):
    html = "<head><title> T &amp; U </title><style>p{}</style></head><h1>H</h1><p>a <b>b</b> < c<!-- no --><script>x</script>\n d</p>"
    row = E.html_to_text(spark.createDataFrame([(html,)], "html string")).first()
    assert row.title == "T & U" and row.text == "T & U\nH\na\nb\n< c\nd" and row.char_count == len(row.text)


def test_html_markup(spark):
    pages = {
        "<!DOCTYPE html>a<!-- b > c -->d<?x y?>e": ("", "a\nd\ne"),
        "<SCRIPT type='x>y'>if (a<b) {}</SCRIPT >t<script/>u<style>open": ("", "t\nu"),
        "<template>x<b>y</b><template>z</template>w</template>v</template>u": ("", "v\nu"),
        "<h2 class='a > b'>One <i>two</i></h2><title>no</title>": ("One two", "One\ntwo\nno"),
        "<template><h1>hid</h1></template><h3>later</h3>": ("", "later"),
        "<header>x</header><h3>never closed <b>&lt;": ("never closed <", "x\nnever closed\n<"),
        "1 < 2 && 3 <p": ("", "1 < 2 && 3 <p"),
        "<p>a &amp; b &lt;i&gt; &eacute; &notit; &unknown; &#65;&#x1F642;&#128;&#0;&#10;z": (
            "", "a & b <i> é ¬it; &unknown; A🙂€\ufffd\nz"),
        None: ("", ""),
        "": ("", ""),
        "<p>" * 3000 + "deep" + "<template>" * 700 + "x" + "</template>" * 700 + "end": ("", "deep\nend"),
        "<p title='" + "long " * 40000 + "'>after": ("", "after"),
    }
    rows = E.html_to_text(spark.createDataFrame([(p,) for p in pages], "html string")).collect()
    assert {r.html: (r.title, r.text) for r in rows} == pages
    assert "Python" not in E.html_to_text(spark.createDataFrame([("",)], "html string"))._jdf.queryExecution().toString()


def test_character_references(spark):
    from html import unescape

    names = ["amp;", "amp", "AMP", "ampx", "nbsp;", "hellip;", "NotEqualTilde;", "CounterClockwiseContourIntegral;", "copy1", "x", "lt;gt;"]
    numbers = ["#1;", "#9", "#11;", "#32;", "#127;", "#129;", "#150;", "#x80", "#xD800;", "#x10FFFF;", "#x110000;", "#xFDD0;", "#xFFFE;",
               "#99999999999999999999;", "#000065;", "#xfeff;", "#;", "#x;", "#X41g"]
    texts = [f"a&{n} b" for n in names + numbers] + ["none", "&", "&&amp;&", "&lt;&amp;lt;"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", E.unescape(F.col("t")).alias("u")).collect()
    assert [(r.t, r.u) for r in got] == [(t, unescape(t)) for t in texts]


def test_running_values(spark):
    import itertools

    from foliant.functions import running as R

    arrays = [[(i * 7919) % 1000 for i in range(n)] for n in (0, 1, 255, 256, 257, 3000)]
    df = spark.createDataFrame([(a,) for a in arrays], "a array<int>")
    got = df.select("a", R.running_sum(F.col("a")), R.running_max(F.col("a")), R.running_min(F.col("a"))).collect()
    for a, total, most, least in got:
        assert total == list(itertools.accumulate(a, initial=0))[: len(a)]
        assert most == list(itertools.accumulate(a, max, initial=0))[: len(a)]
        assert least == list(itertools.accumulate(a, min, initial=2**31 - 1))[: len(a)]


def test_table_drops_empty_rows_and_pads(spark):
    cells = [(0, 0, "h"), (0, 1, None), (1, 0, ""), (2, 0, "long"), (2, 1, "b"), (2, 2, "c")]
    df = spark.createDataFrame([("t", *c) for c in cells], "t string, row int, col int, cell string")
    row = E.table_to_markdown(df, ["t"]).first()
    assert row.markdown == "| h    |   |   |\n|------|---|---|\n| long | b | c |"
    single = E.table_to_markdown(df.where("row = 2"), ["t"]).first()
    assert single.markdown == "| long | b | c |" and not single.has_header


@pytest.mark.parametrize(
    "size, pages, dpi",
    [(4.9, 10, 300), (5, 19, 300), (5, 20, 250), (20, 100, 250), (39, 101, 200), (40, 1, 200), (1, 101, 200), (1, 107, 200), (1, 100, 300), (10, 100, 250)],
)
def test_ocr_plan(spark, size, pages, dpi):
    row = E.plan_ocr(spark.createDataFrame([(float(size), pages)], "size_mb double, pages int")).first()
    assert row.dpi == dpi


def test_heading_case(spark):
    for text, want in [("ABC 1", True), ("Title Case Here", True), ("Not title", False), ("123", False), ("x" * 3, False), ("A" * 100, False), ("McD", False)]:
        assert one(spark, text, E.looks_like_heading) == want, text
        assert want == (len(text) < 100 and (text.isupper() or text.istitle()))


def test_split_for_correction(spark):
    text = "Aaaa. Bbbb. Cccc"
    assert one(spark, text, lambda c: E.split_for_correction(c, 11)) == ["Aaaa. Bbbb.", "Cccc."]
    assert one(spark, "x" * 30 + ". yy", lambda c: E.split_for_correction(c, 10)) == ["x" * 30 + ".", "yy."]


# --- embedding and catalog -----------------------------------------------------------------


def test_failing_texts_have_no_vector(spark):
    def model(texts):
        if any("bad" in t for t in texts):
            raise ValueError
        return [[float(len(t))] for t in texts]

    df = spark.createDataFrame([("a",), ("bad",), (" ",), (None,), ("bb",)], "text string").coalesce(1)
    assert [r.embedding for r in M.embed(df, model=model).collect()] == [[1.0], None, None, None, [2.0]]


def test_gate(spark):
    df = spark.createDataFrame([("x", [1.0]), ("x", None), ("y", [1.0]), ("y", None), ("y", None)], "doc_id string, embedding array<double>")
    kept, verdict = M.embedding_gate(df)
    assert [r.doc_id for r in kept.collect()] == ["x"]
    assert {r.doc_id: r.passed for r in verdict.collect()} == {"x": True, "y": False}


def test_update_without_insert(spark):
    cat = spark.createDataFrame([(1, "a", "m")], "id int, status string, message string")
    up = spark.createDataFrame([(1, 1, "b", None), (1, 2, "c", None), (2, 1, "x", "y")], "id int, version int, status string, message string")
    assert [tuple(r) for r in G.upsert_catalog(cat, up, insert=False).collect()] == [(1, "c", "m")]
    assert G.upsert_catalog(cat, up).count() == 2


# --- conversations ------------------------------------------------------------------------


def messages(spark, contents, sender="human"):
    rows = [("c", 1, i, sender, t, "[]") for i, t in enumerate(contents)]
    return spark.createDataFrame(rows, "course_id string, chat_id int, seq int, sender string, content string, citations string")


def test_context_budget_is_inclusive_and_stops(spark):
    m = messages(spark, ["x" * 8, "y" * 100, "z" * 8, "w" * 8])
    kept = lambda b, **k: sorted(r.seq for r in MS.context_window(m, 8, b, F.length("content"), **k).collect())
    assert kept(16) == [2, 3] and kept(15) == [3] and kept(None) == [0, 1, 2, 3]
    assert kept(8, skip_newest=True) == [2] and kept(16, drop_newest=True) == [2]


def test_bots_are_deduplicated_by_citation(spark):
    rows = [("c", 1, i, s, "same", c) for i, (s, c) in enumerate([("bot", "a"), ("bot", "b"), ("bot", "a"), ("human", "a"), ("human", "b")])]
    df = spark.createDataFrame(rows, messages(spark, ["x"]).schema)
    assert sorted(r.seq for r in MS.dedup_messages(df).collect()) == [0, 1, 3]


def test_deep_and_shallow_pages_agree(spark):
    m = messages(spark, [str(i) for i in range(50)])
    near = sorted(r.seq for r in MS.page_newest_first(m, 10, 5).collect())
    assert near == list(range(35, 45))
    assert len(MS.page_newest_first(m, 2000, 45).collect()) == 5


@pytest.mark.parametrize("bound", [1 << 20, 0])
def test_substrings_on_both_paths(spark, bound):
    texts = ["abcdefghijk", "xxabyy", "a", "Ünïcode ☃ snow", "zzzz", ""]
    needles = ["cdefghij", "ab", "a", "☃", "abcdefghijkl", "ïco", "zz", ""]
    t = spark.createDataFrame(list(enumerate(texts)), "id int, haystack string")
    n = spark.createDataFrame(list(enumerate(needles)), "q int, needle string")
    got = {(r.q, r.id) for r in find_substrings(n, t, ["id"], bound).collect()}
    assert got == {(i, j) for i, x in enumerate(needles) for j, y in enumerate(texts) if x and x in y}


def test_search_snippets(spark):
    text = "s" * 60 + "NEEDLE" + "e" * 60
    m = messages(spark, ["no", text, "needle later"])
    chats = spark.createDataFrame([("c", 1, "Chat", 5)], "course_id string, chat_id int, title string, latest_activity int")
    q = spark.createDataFrame([(1, " Needle"), (2, "CHAT"), (3, " "), (4, "ha")], "query_id int, query string")
    out = {r.query_id: r for r in MS.search_chats(q, chats, m).collect()}
    assert set(out) == {1, 2, 4}
    assert out[1].snippet == "..." + "s" * 50 + "NEEDLE" + "e" * 50 + "..." and out[1].match_type == "content"
    assert (out[1].before, out[1].match[:6], out[1].score) == ("..." + "s" * 50, "NEEDLE", 0.8)
    assert out[2].match_type == "exact-title" and out[4].match_type == "partial-title" and out[2].snippet is None


def test_responses(spark):
    rows = [(1, i, "abcd") for i in range(5)] + [(2, 0, " "), (3, 0, "part")]
    df = spark.createDataFrame(rows, "chat int, seq int, token string")
    out = {r.chat: (r.answer, r.truncated) for r in MS.assemble_response(df, ["chat"], F.col("chat") == 3, limit=10).collect()}
    assert out == {1: ("abcdabcdabcd" + L.TRUNCATED_NOTE, True), 3: ("part" + L.TIMEOUT_NOTE, False)}


def test_titles(spark):
    cases = {
        "hello world": "Hello World",
        "": L.NEW_CHAT,
        "How do I sort a list in the Python language quickly? Thanks": "How Do Sort List Python Language",
        "Short one. And then a lot more words follow in this message": "Short One.",
        "see https://x.y now": "See Now",
        "please explain all of the very long story": "Please Explain All Very Long Story",
    }
    assert {k: one(spark, k, T.fallback_title) for k in cases} == cases
    word = "x" * 1_100_000  # no word is cut
    assert one(spark, word, T.title_case) == "X" + word[1:]


def test_candidates_and_choice(spark):
    reply = "1. Title: **Sorting lists**\n2. \"chat about it\"\n3. Sorting lists\n4. never read"
    got = one(spark, reply, T.parse_title_candidates)
    assert got == ["Sorting Lists", "Chat About It"]
    assert one(spark, "a, b", T.parse_title_candidates) == ["A, B"]
    pick = lambda c: T.choose_title(c, F.lit("sorting my lists"))
    assert one(spark, ["Chat Sorting Lists Now", "Sorting Lists"], pick, "array<string>") == "Sorting Lists"
    long = "word " * 3 + "x" * 80
    assert one(spark, long, T.finish_candidate).endswith("...")


def test_chat_names(spark):
    errors = {"ok name": None, "  ": "empty", "x" * 51: "50", "bad/name": "invalid", " fine! ": None}
    for name, want in errors.items():
        got = one(spark, name, T.chat_name_error)
        assert (got is None) == (want is None) and (want or "") in (got or "")


# --- telemetry -----------------------------------------------------------------------------


def test_thresholds_and_times(spark):
    names = {"searchQuery": 200.0, "my:SEARCHQUERY:x": 200.0, "fileUpload:searchQuery": 200.0, "other": None}
    for name, want in names.items():
        assert one(spark, name, O.slow_threshold) == want
    times = {None: "Unknown", 0.5: "< 1s", 59.9: "59s", 150.0: "2m 30s", 3700.0: "1h 1m"}
    for s, want in times.items():
        assert one(spark, s, O.format_remaining, "double") == want


def test_error_rules(spark):
    assert one(spark, "spawn timeout", O.classify_error) == "PROCESS_SPAWN"
    assert one(spark, "invalid network", O.retryable) and not one(spark, "Not found", O.retryable)
    assert one(spark, "weird", O.friendly_upload_error) == "weird"
    assert one(spark, "looking at it", O.friendly_upload_error) == L.UPLOAD_ERROR_FALLBACK


# --- streams -------------------------------------------------------------------------------


def test_cancelled_documents_disappear(spark):
    rows = [(0, "a", "Parse", "In Progress"), (1, "b", "Parse", "In Progress"), (2, "a", "Parse", "Finished"), (3, "b", "Parse", SS.CANCELLED)]
    df = spark.createDataFrame(rows, "event_id long, id string, stage string, progress string").select(
        "*", F.timestamp_seconds("event_id").alias("ts"), F.lit(0).alias("completed"), F.lit(0).alias("total"))
    out = {(r.id, r.stage): r.progress for r in SS.stream_latest_state(replay(df, "event_id", 4)).collect()}
    assert out[("a", "Parse")] == "Finished" and out[("a", "Initialize")] == "Finished" and out[("a", "Embed")] == "Not Started"
    assert {k for k, _ in out} == {"a"}


def test_partial_answers_grow_over_batches_and_clear(spark):
    rows = [(1, "a"), (2, "b"), (3, ""), (4, "c"), (5, "d")]
    df = spark.createDataFrame([("x", s, t) for s, t in rows] + [("y", 1, "q"), ("y", 6, "")], "chat string, seq long, token string")
    out = SK.stream_partial_message(replay(df, "seq", 3), "chat").collect()
    assert [(r.chat, r.answer) for r in out] == [("x", "cd")]


def test_answers_do_not_depend_on_arrival(spark):
    said = [(1, "old "), (2, ""), (3, "a "), (4, "b "), (5, "c "), (6, "d ")]
    # the clearing token and those before it arrive last
    rows = [("x", s, t, -s) for s, t in said] + [("y", s, t, s * 7 % 5) for s, t in said if t]
    df = spark.createDataFrame(rows, "chat string, seq long, token string, arrival long")
    out = SK.stream_partial_message(replay(df, "arrival", 3).drop("arrival"), "chat").collect()
    assert {r.chat: r.answer for r in out} == {"x": "a b c d ", "y": "old a b c d "}
    short = SK.partial_answer_stream(replay(df, "arrival", 3).drop("arrival"), "chat", limit=3)
    last = latest_per_key(run_to_table(short, "update"), ["chat"]).collect()
    assert {r.chat: r.answer for r in last} == {"x": "a b ", "y": "old "}


def test_a_late_question_changes_earlier_verdicts(spark):
    # 0 s arrives last: it stores, and nothing had been stored before it
    rows = [("k", 1, 10_000, 1), ("k", 2, 10_100, 2), ("k", 3, 20_000, 3), ("k", 4, 0, 4), ("k", 5, 9_900, 5)]
    df = spark.createDataFrame(rows, "memo_key string, query_id long, s long, arrival long")
    df = df.withColumn("asked_at", F.timestamp_seconds("s"))
    out = {r.query_id: r.hit for r in SK.stream_memo(replay(df, "arrival", 5).drop("arrival"), ttl=300).collect()}
    assert out == {4: False, 5: False, 1: True, 2: True, 3: False}


@pytest.mark.parametrize("parts", [1, 4, 9])
def test_shuffled_events_give_the_batch_verdicts(spark, parts):
    rng = random.Random(parts)
    rows = [(rng.choice("ab"), i, rng.randrange(5000), rng.random()) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, id long, s long, arrival double").withColumn("at", F.timestamp_seconds("s"))
    batch = spaced(df.withColumn("t", F.unix_micros("at")), ["k"], "t", 90_000_000)
    want = {r.id: r.kept for r in batch.collect()}
    out = SK.stream_throttle(replay(df, "arrival", parts).drop("arrival"), "k", "id", "at", 90_000_000)
    assert {r.id: r.forwarded for r in out.collect()} == want


def test_events_older_than_the_state_still_come_out(spark):
    day = 86400
    # every other event is a day older than the one before it
    rows = [("k", i, 1_700_000_000 + 60 * i - day * (i % 2)) for i in range(120)]
    df = spark.createDataFrame(rows, "k string, id long, s long").withColumn("at", F.timestamp_seconds("s"))
    out = SK.stream_throttle(replay(df, "id", 4), "k", "id", "at", 90_000_000, late=3600_000_000).collect()
    assert len(out) == 120 and not any(r.forwarded for r in out if r.id % 2 and r.id >= 90)
    assert sum(r.forwarded for r in out if not r.id % 2) == 60


def test_streamed_events_without_time_or_key_and_over_many_blocks(spark):
    # 300 gaps are several time blocks; a missing key is a key, an event without a time is not kept
    rows = [(k, i, 90 * i + i % 2, i * 7 % 10) for i in range(300) for k in (None, "a")] + [("a", 900, None, 3), ("b", 901, None, 4)]
    df = spark.createDataFrame(rows, "k string, id long, s long, arrival long").withColumn("at", F.timestamp_seconds("s"))
    out = SK.stream_throttle(replay(df, "arrival", 3).drop("arrival"), "k", "id", "at", 90_000_000).collect()
    got = {(r.k, r.id): r.forwarded for r in out}
    last, want = None, {}
    for i in range(300):
        want[i] = last is None or 90 * i + i % 2 >= last + 90
        last = 90 * i + i % 2 if want[i] else last
    assert got == {(k, i): v for i, v in want.items() for k in (None, "a")} | {("a", 900): False, ("b", 901): False}


def test_streamed_ingest_equals_batch_and_reuses_vectors(spark):
    docs = [(f"d{i}", f"d{i}.txt", ".txt", f"Text number {i % 3}. More of it.", i) for i in range(6)] + [("e", "e.exe", ".exe", "x", 1)]
    df = spark.createDataFrame(docs, "doc_id string, name string, ext string, text string, n long").select(
        "doc_id", "name", "ext", F.length("text").alias("size"), F.lit("text/plain").alias("mime"), F.col("text").cast("binary").alias("content"), "n")
    chunks, reports = SI.stream_ingest(replay(df, "n", 3).drop("n"))
    assert chunks.where("embedding IS NULL").count() == 0 and chunks.count() == 6
    status = {r.doc_id: r.status for r in reports.collect()}
    assert status["e"] == "failed" and sum(s == "completed" for s in status.values()) == 6
    by_text = chunks.groupBy("text").agg(F.countDistinct("embedding").alias("n")).collect()
    assert all(r.n == 1 for r in by_text)


def test_index_log_folds(spark):
    rows = [("message", 1, 0, "hi", None), ("title", 1, 1, None, "New"), ("message", 2, 2, "gone", None), ("remove", 2, 3, None, None), ("message", 2, 4, "back", None)]
    df = spark.createDataFrame([(k, "c", c, a, a, t, n) for k, c, a, t, n in rows],
        "kind string, course_id string, chat_id int, at long, seq long, content string, title string")
    chats, msgs = SI.stream_search_index(replay(df, "at", 5))
    assert sorted((r.chat_id, r.content) for r in msgs.collect()) == [(1, "hi"), (2, "back")]
    assert {r.chat_id: r.title for r in chats.collect()} == {1: "New", 2: None}
