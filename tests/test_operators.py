"""Operators on small rows, one behaviour at a time."""

import re

import pytest
from pyspark.sql import functions as F

from quillspark import gateway
from quillspark.functions import text as tx
from quillspark.operators import archive, brief, catalog, chunking, compression, history, output, ranking, sanitize, state, summarize
from quillspark.sources import parsers, workspace
from quillspark.streaming import stats


def one(spark, text, fn):
    return spark.createDataFrame([(text,)], "text string").select(fn(F.col("text")).alias("x")).first()["x"]


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


@pytest.mark.parametrize(("text", "n"), [("", []), ("a\n", ["a"]), ("a\r\n\r\nb", ["a", "", "b"]), ("\n", [""])])
def test_lines(spark, text, n):
    assert one(spark, text, tx.lines) == n


def test_byte_floor_keeps_whole_characters(spark):
    for n in range(9):
        assert one(spark, "aé🎉b", lambda t, n=n: tx.byte_floor(t, n)) == "aé🎉b".encode()[:n].decode(errors="ignore")


def test_json_must_be_the_whole_text(spark):
    assert one(spark, '{"a": 1}\nmore', compression.detect_type) == "text"
    assert one(spark, ' {"b": 1, "a": [1, 2]} ', compression.detect_type) == "json"
    got = gateway.run("filter", docs(spark, '{"b": 1,  "a": [1, 2]}')).first()
    assert got.content == '{"a":[1,2],"b":1}'


def test_fold_similar(spark):
    a = "the quick brown fox jumps over it\nThe quick brown fox jumps over it\n\nthe quick brown fox jumps over it\nother\nother"
    assert one(spark, a, lambda t: compression.fold_similar(tx.lines(t))) == ["the quick brown fox jumps over it", "", "the quick brown fox jumps over it", "other"]


def test_squeeze_code(spark):
    a = "fn main() {\n  // gone\n  // TODO keep\n/* a\nb\nc */\n  let x = 1;\n}\n#!sh\n# gone too\n/// doc"
    assert one(spark, a, lambda t: compression.squeeze_code(tx.lines(t))) == ["fn main() {", "// TODO keep", "let x = 1;", "#!sh", "/// doc"]


def test_compact_json(spark):
    got = one(spark, '{"k": [1,2,3,4,5,6,7,8,9], "s": "' + "é" * 200 + '"}', compression.compact_json)
    assert got == '{"k":[1,2,3,"…(+5 items)",9],"s":"' + "é" * 100 + '…(+200c)"}'
    wide = "{" + ",".join(f'"k{i:02}": {i}' for i in range(30)) + ', "title": "t"}'
    got = one(spark, wide, compression.compact_json)
    assert '"title":"t"' in got and '"_truncated_keys":16' in got


def test_compress_bypasses_short_text(spark):
    got = compression.compress(docs(spark, "short", "user: hello\n" + "a b c\n" * 400)).orderBy("doc_id").collect()
    assert got[0].bypassed and got[0].content == "short" and not got[1].bypassed and got[1].metrics.result_tokens < got[1].metrics.original_tokens


def test_compress_output(spark):
    log = "diff --git a b\n@@ -1 +1 @@\n kept\n dropped\n+new\n"
    got = output.compress_output(docs(spark, log, "\n".join(f"line {i}" for i in range(200)))).orderBy("doc_id").collect()
    assert got[0].domain == "git" and got[0].content == "diff --git a b\n@@ -1 +1 @@\n kept\n+new"
    assert got[1].domain == "generic" and "…[120 lines omitted]…" in got[1].content and got[1].lines_out == 81


def test_sanitize_rules_in_order(spark):
    secret = "OPENAI_API_KEY=" + "sk" + "-abcdefghijklmnopqrst"
    got = sanitize.sanitize(docs(spark, secret, "clean", None)).orderBy("doc_id").collect()
    assert [f.label for f in got[0].findings] == ["openai_sk", "assignment_secret"] and got[0].redacted_count == 2 and got[0].content == "[REDACTED_ASSIGNMENT]"
    assert got[1].findings == [] and got[1].content == "clean" and got[2].content == ""
    got = one(spark, '{"hint": "do it", "is_visible": false}', sanitize.scrub)
    assert got == '{"hint": [STRIPPED_POISON_PARAM], "is_visible": [STRIPPED_POISON_PARAM]}'


def test_summaries(spark):
    talk, tree = "user: hi there. more\nassistant: a long enough answer follows here.\n", "src/\n  src/a.rs\n  src/b.rs\n  src/c.py\n  src/d.md\nREADME.md/x.md"
    got = {r.mode: r.summary for r in summarize.summarize(docs(spark, talk, tree, "# One\ntext one. two\n### Deep\nx\n# Two\ny."), max_depth=2, force=True).collect()}
    assert got["conversation"].startswith("# Conversation (2 turns)\n- T1 [user]: hi there.…\n- T2 [assistant]:")
    assert "- 5 files across 1 directories" in got["filetree"] and "- .md: 2" in got["filetree"]
    assert got["outline"] == "# One\n- text one.…\n# Two\n- y.\n"


def test_ranking(spark):
    d = docs(spark, "alpha beta gamma", "alpha alpha ERROR 404", "nothing here", "", None)
    got = ranking.bm25(d, "alpha 404").orderBy(F.desc("bm25_score"), "doc_id").collect()
    assert [r.doc_id for r in got][:2] == [1, 0] and got[2].bm25_score == 0.0
    kept = ranking.filter_relevant(docs(spark, "noise\nfound alpha here\nmore noise\ncode 404"), "alpha 404").first()
    assert kept.content == "found alpha here\ncode 404"
    assert ranking.filter_relevant(docs(spark, "\n".join(f"w{i}" for i in range(20))), "zzz").first().lines_kept == 8


def test_rerank_modes(spark):
    d = spark.createDataFrame([(0, "alpha", [1.0, 0.0], None), (1, "beta", [0.0, 1.0], 0.9), (2, "alpha beta", [1.0, 1.0], 0.2), (3, "none", [-1.0, 0.0], None)], "doc_id long, text string, v array<float>, ce double")
    assert [r.doc_id for r in ranking.rerank(d, "alpha").collect()] == [0, 2]
    hybrid = ranking.rerank(d, "alpha", embedding="v", query_vector=[1.0, 0.0], top_k=3).collect()
    assert [r.doc_id for r in hybrid][0] == 0 and len(hybrid) == 3 and hybrid[0].backend == "hybrid"
    ce = ranking.rerank(d, "alpha", top_k=4, scorer="ce", scorer_top=4).collect()
    assert [r.doc_id for r in ce] == [1, 2, 0, 3]
    assert [r.score for r in ranking.rerank(d, "alpha", min_score=99.0).collect()] == [0.0] * 4
    assert [one(spark, t, ranking.parse_score) for t in ("0.4", "score: 87%", "-3")] == [0.4, 0.87, 0.0]


def test_prune(spark):
    rows = [(1, k, "user" if k % 2 else "assistant", t) for k, t in enumerate(["long first question about things", "ok", "an answer of some length follows", "thanks!", "next question then?", "final answer here"])]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert [r.turn for r in history.prune_history(d, "remove").orderBy("turn").collect()] == [0, 2, 4, 5]
    got = history.prune_history(d, "afm", keep_last=1, thematic=1).orderBy("turn").collect()
    assert [r.tier for r in got] == ["distant", "thematic", "critical"] and got[0].text.startswith("[distant memory ref=cmp://afm/") and "2 turns omitted" in got[0].text
    got = history.prune_history(d, "hybrid", keep_last=2).orderBy("turn").collect()
    assert got[0].text.startswith("[earlier conversation summary]\n# Conversation (2 turns)") and len(got) == 3
    assert [r.turn for r in history.within_budget(d, 1).collect()] == [5]


def test_chunks_cover_the_text_and_resolve(spark):
    body = "\n\n".join(f"# Part {i}\n" + "some words of text. " * 40 for i in range(12))
    parts = chunking.chunk(docs(spark, body, "tiny", ""), chunk_tokens=128, overlap_tokens=16)
    rows = parts.where("doc_id = 0").orderBy("index").collect()
    assert len(rows) > 6 and all(r.tokens <= 256 for r in rows) and all(f"# Part {i}\n" in "".join(r.content for r in rows) for i in range(12))
    assert parts.where("doc_id = 2").count() == 0
    wanted = spark.createDataFrame([(0, rows[3].chunk_id), (0, "cmp://other/2"), (1, "cmp://other/9")], "doc_id long, id string")
    got = {r.id: r.content for r in chunking.resolve(wanted, parts).collect()}
    assert got == {rows[3].chunk_id: rows[3].content, "cmp://other/2": rows[2].content, "cmp://other/9": None}


def test_cache(spark):
    put = spark.createDataFrame([("a", "one"), ("b", "two"), ("a", "new")], "key string, content string").withColumn("put_at", F.when(F.col("content") == "new", 9).otherwise(1).cast("long"))
    cache = state.cache_put(None, put, now=10, ttl=5)
    keys = spark.createDataFrame([("a",), ("c",)], "key string")
    assert {(r.key, r.content, r.hit) for r in state.cache_get(cache, keys, 12).collect()} == {("a", "new", True), ("c", None, False)}
    assert state.cache_get(cache, keys, 15).where("hit").count() == 0
    assert [r.key for r in state.cache_invalidate(cache, keys).collect()] == ["b"] and state.cache_invalidate(cache).count() == 0
    assert [r.key for r in state.cache_evict(cache, 3, 12).collect()] == ["a"]


def test_audit_masks_credentials(spark, tmp_path):
    rows = spark.createDataFrame([("x", "bad token abc"), ("y", "z" * 300), ("w", None)], "action string, error string")
    state.write_audit(rows, str(tmp_path / "audit"))
    got = {r.action: r.error for r in spark.read.json(str(tmp_path / "audit")).collect()}
    assert got == {"x": "[REDACTED]", "y": "z" * 200, "w": None}


def test_archives(spark):
    rows = spark.createDataFrame([(1, "a.txt", "A"), (1, "b/c.txt", "é" * 9), (2, "../up", "x"), (3, "big", "y" * 100)], "archive_id long, path string, text string")
    made = {r.archive_id: r for r in archive.pack(rows, max_plain=50).collect()}
    assert made[1].error is None and made[1].file_count == 2 and made[2].error == "unsafe path ../up" and made[3].error == "too many bytes" and made[3].archive is None
    back = archive.unpack(archive.pack(rows, max_plain=50))
    assert {tuple(r) for r in back.collect()} == {(1, "a.txt", "A", None), (1, "b/c.txt", "é" * 9, None)}


def test_parsers(spark):
    got = parsers.transcript(docs(spark, "intro\nuser: one\nmore\nAI: two", '[{"role": "system", "content": "s"}, {"content": "t"}]')).orderBy("doc_id", "turn").collect()
    assert [(r.doc_id, r.role, r.text) for r in got] == [(0, "user", "intro"), (0, "user", "one\nmore"), (0, "assistant", "two"), (1, "system", "s"), (1, "user", "t")]
    items = parsers.rerank_items(docs(spark, '["a", "b"]', '[{"id": "x", "text": "t"}]', "p one\n\np two", "l1\nl2")).orderBy("doc_id", "index").collect()
    assert [(r.doc_id, r.id, r.text) for r in items] == [(0, None, "a"), (0, None, "b"), (1, "x", "t"), (2, None, "p one"), (2, None, "p two"), (3, None, "l1"), (3, None, "l2")]
    parts = parsers.pack_sections(docs(spark, "a.txt\n---\nbody\n===\nb.txt\n---\nother", "plain")).collect()
    assert {(r.path, r.text) for r in parts} == {("a.txt", "body"), ("b.txt", "other"), ("input.txt", "plain")}


def test_brief_over_a_workspace(spark, tmp_path):
    for name, text in {"src/retry.py": "def retry_policy():\n    return 3\n", "docs/retry.md": "# Retry policy\nThe retry policy is three attempts.\n", "node_modules/x.js": "retry_policy", "bin.py": "a\0b", "other.txt": "nothing"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    seen = workspace.files(spark, str(tmp_path))
    assert {(r.path, r.kind) for r in seen.collect()} == {("src/retry.py", "code"), ("docs/retry.md", "doc"), ("other.txt", "doc")}
    got = brief.brief(spark, str(tmp_path), "retry_policy attempts", now=4102444800).collect()
    assert {r.path for r in got} >= {"src/retry.py", "docs/retry.md"} and [r["rank"] for r in got] == sorted(r["rank"] for r in got)


def test_ignore_files_and_allowed_root(spark, tmp_path):
    (tmp_path / ".gitignore").write_text("# none\n*.md\n!keep.md\n/top/\nsub/**/x.py\n")
    for name in ("a.md", "keep.md", "top/b.py", "in/top/b.py", "sub/x.py", "sub/y/z/x.py", "sub/w.py", "Makefile", "noext"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("some text")
    assert {r.path for r in workspace.files(spark, str(tmp_path)).collect()} == {"keep.md", "in/top/b.py", "sub/w.py", "Makefile"}
    assert workspace.checked_root(str(tmp_path / "in"), str(tmp_path)) and workspace.checked_root("s3://b/x", "s3://b")
    for root in (str(tmp_path / ".." / "else"), "s3://b/x"):
        with pytest.raises(ValueError, match="outside"):
            workspace.checked_root(root, str(tmp_path))


def test_query_windows(spark):
    parts = [f"w{i} " * 200 for i in range(30)]
    body = "".join(parts[:17]) + " needle404 here " + "".join(parts[17:])
    d = docs(spark, body, body, "small", None)
    got = workspace.query_windows(d, "needle404", 3000, F.col("doc_id").isin(0, 3)).orderBy("doc_id").collect()
    assert "needle404" in got[0].text and len(got[0].text.encode()) <= 3000 + 3 * len(workspace.WINDOW_BREAK)
    assert got[1].text == body and got[2].text == "small" and got[3].text == ""
    none = workspace.query_windows(d, "zzz", 3000, F.col("doc_id") == 0).where("doc_id = 0").first().text
    assert none.startswith("w0 w0")


def test_evidence_cuts_what_does_not_fit(spark):
    rows = spark.createDataFrame([(1, "code", "word " * 100), (2, "code", "more " * 400), (3, "doc", "text " * 10)], "rank int, kind string, text string")
    got = {r["rank"]: r.text for r in brief.evidence(rows, 300).collect()}
    assert got[1] == "word " * 100 and got[2].endswith("…[truncated]") and len(got[2]) < 1300
    got = brief.evidence(rows.where("rank = 2"), 30).collect()
    assert len(got) == 1 and got[0].text.endswith("…[truncated]")
    assert brief.evidence(rows.limit(0), 300).count() == 0


def test_briefing_has_six_headings(spark, tmp_path):
    import os

    for name, text, at in (("src/retry.py", "def retry_policy():\n    return 3\n", 1704067200), ("docs/retry.md", "# Retry policy\nThe retry policy: password=hunter2hunter2\n", 1700000000)):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
        os.utime(tmp_path / name, (at, at))
    got = gateway.run("brief", spark, str(tmp_path), "rank retry_policy", now=1704067200).first()
    assert re.findall(r"(?m)^## (.*)$", got.briefing) == ["Task", "Status", "Evidence", "Caveats", "Sources", "Read next"]
    assert "possibly stale: docs/retry.md" in got.briefing and "hunter2" not in got.briefing and "cmp://skill/action/rerank" in got.briefing
    assert got.sources[0] == "src/retry.py" and got.selected_files == 2 and got.cache_key.startswith("cache://brief/")


def test_sections_totals_and_ratios(spark):
    got = summarize.with_sections(docs(spark, "# One\ntext one.\n## Two\nx"), mode="outline").first().sections
    assert [(s.level, s.title, s.bullets) for s in got] == [(1, "One", ["text one."]), (2, "Two", ["x"])]
    talk = spark.createDataFrame([(1, 0, "user", "a long question about things"), (1, 1, "user", "ok")], "conv_id long, turn long, role string, text string")
    got = history.prune_totals(talk, history.prune_history(talk, "remove")).first()
    assert (got.messages, got.dropped, got.kept) == (2, 1, 1) and got.result_tokens < got.original_tokens
    calls = spark.createDataFrame([(10, 4, True, "ad"), (5, 9, False, "full"), (5, 5, False, "follow"), (0, 0, False, None)], "original_tokens long, result_tokens long, bypassed boolean, lazy string")
    got = state.session_stats(calls).first()
    assert (got.tokens_saved, got.bypass_ratio, got.lazy_hit_rate) == (6, 0.25, 0.5)


def test_playbooks(spark, tmp_path):
    (tmp_path / "logs.md").write_text("---\nid: noisy\nname: Noisy logs\ndescription: shrink logs\ntags: logs, noise\n---\nStep: password=hunter2hunter2\n")
    books = catalog.playbooks(spark, str(tmp_path))
    assert catalog.playbook(books, "noisy").first().body.strip() == "Step: [REDACTED_ASSIGNMENT]"
    assert [r.id for r in catalog.suggest(books, "shrink my logs").collect()] == ["noisy"] and catalog.suggest(books, "zzz").count() == 0


def test_gateway_covers_the_catalog(spark):
    assert {r.id for r in catalog.catalog(spark).collect()} == set(gateway.ACTIONS)
    got = gateway.run("filter", docs(spark, "key password=hunter2hunter2"), sanitize_input=True).first()
    assert "hunter2" not in got.content
    with pytest.raises(ValueError, match="unknown action"):
        gateway.run("nope", None)


def test_stream_statistics(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:10:00", "filter", 10, 4), ("2024-01-01 00:50:00", "filter", 5, 9), ("2024-01-01 02:00:00", "chunk", 7, 7)], "ts string, action string, original_tokens long, result_tokens long")
    rows.withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, action string, original_tokens long, result_tokens long").parquet(str(tmp_path / "in"))
    q = stats.windowed_stats(stream).writeStream.format("memory").queryName("stats").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r.action, r.calls, r.tokens_saved) for r in spark.sql("SELECT * FROM stats").collect()} == {("filter", 2, 6), ("chunk", 1, 0)}


def test_no_other_module_imports_the_optional_part():
    from pathlib import Path

    import quillspark

    root = Path(quillspark.__file__).parent
    assert not [p for p in root.rglob("*.py") if "llm" not in p.relative_to(root).parts and re.search(r"\bllm\b", p.read_text()) and "import" in p.read_text() and re.search(r"from.*\bllm\b|import.*\.llm\b", p.read_text())]


def test_archives_are_whole_or_an_error(spark):
    import base64
    import io
    import zipfile

    def zipped(names):
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w") as z:
            for n in names:
                z.writestr(n, "text of " + n)
        return held.getvalue()

    rows = [(1, zipped([f"f{i}" for i in range(60)])), (2, b"no zip"), (3, zipped(["../up"])), (4, zipped(["a" * 90])), (5, zipped(["ok"])), (6, zipped([])), (7, None), (8, zipped(["x"])[:-30])]
    got = archive.unpack(spark.createDataFrame(rows, "archive_id long, archive binary"), max_plain=60).collect()
    assert {r.archive_id: (r.path, r.text) for r in got if r.error is None} == {5: ("ok", "text of ok")}
    assert sorted(r.archive_id for r in got if r.error) == [1, 2, 3, 4, 6, 8] and "60 files" in next(r.error for r in got if r.archive_id == 1)
    texts = spark.createDataFrame([(5, base64.b64encode(rows[4][1]).decode()), (9, "???")], "archive_id long, archive string")
    assert {(r.archive_id, r.path) for r in archive.unpack(texts).collect()} == {(5, "ok"), (9, None)}
    given = spark.createDataFrame([(1, "a", None), (1, "b", "x" * 30), (None, "c", "y"), (2, None, "z")], "archive_id long, path string, text string")
    made = {r.archive_id: r for r in archive.pack(given, include_base64=True).collect()}
    assert made[1].error is None and made[1].uncompressed_bytes == 30 and base64.b64decode(made[1].base64) == bytes(made[1].archive) and made[1].cache_key.startswith("cache://pack/")
    assert made[None].error is None and made[None].file_count == 1 and made[2].error == "unsafe path None" and made[2].archive is None
    chunks = archive.unpack_chunks(archive.pack(given), chunk_tokens=64, overlap_tokens=8).where("archive_id = 1").orderBy("index").collect()
    assert chunks[0].content.startswith("# file: a\n") and "# file: b\n" + "x" * 30 in "".join(c.content for c in chunks)


def test_deep_json_does_not_end_the_job(spark):
    rows = docs(spark, "[" * 100_000, '{"a": ' * 3000 + "1" + "}" * 3000, '{"k": [1,2,3]}', None)
    got = compression.compress(rows, force=True, content_type="json", prefilter=False, max_tokens=10**6).orderBy("doc_id").collect()
    assert got[0].content.endswith("[" * 100) and got[2].content == '{"k":[1,2,3]}' and got[3].content == ""


def test_patterns_that_java_refuses_are_ignored(spark):
    got = gateway.run("filter", docs(spark, "abc\nxyz"), drop=["(?P<n>abc)", "[", "^x"]).first()
    assert got.content == "abc"


def test_columns_of_the_user_stay(spark):
    names = "_tok _lines _l _t _f _s _a _b _w _r _t0 _n0 facts counts lines scores rows body work low step n avgdl df0 lo hi source_text budget_sum met windows chosen".split()
    d = docs(spark, "an error line 404\nalpha beta", "short").withColumns({n: F.lit(n) for n in names})
    outs = [
        ranking.bm25(d, "alpha 404"), ranking.keep_lines(d, "alpha"), gateway.run("filter", d, query="alpha"), gateway.run("compress", d, force=True), gateway.run("compress_output", d), gateway.run("sanitize", d),
        gateway.run("summarize_smart", d, query="alpha"), workspace.query_windows(d, "alpha", 3000, F.col("doc_id") == 0), ranking.min_max(d.withColumn("x", F.col("doc_id")), "x", "y"),
    ]
    for out in outs:
        assert out.where("doc_id = 0").select(*names).first().asDict() == {n: n for n in names}


def test_long_texts_take_one_pass(spark):
    n = 100_000
    log = "\n".join(f"2024-01-01T10:00:00Z [app] event {i % 50_000}" for i in range(n))
    code = "\n".join(["/*", "gone", "*/", "let x = 1;"] * (n // 4))
    cargo = "\n".join(["    Compiling a", "warning: b"] * (n // 2))
    d = spark.createDataFrame([(log, code, cargo)], "log string, code string, cargo string")
    got = d.select(F.size(compression.group_logs(tx.lines(F.col("log")))).alias("a"), F.size(compression.squeeze_code(tx.lines(F.col("code")))).alias("b"), F.size(output.cargo_lines(tx.lines(F.col("cargo")))).alias("c")).first()
    assert (got.a, got.b, got.c) == (50_000, n // 4, n // 2 + 4)
    talk = "\n".join(f"user: line {i}" for i in range(20_000))
    assert parsers.transcript(docs(spark, talk)).count() == 20_000


def test_last_turn_is_cut_to_the_budget(spark):
    rows = spark.createDataFrame([(1, 0, "user", "first"), (1, 1, "user", "word " * 500), (2, 0, "user", "short")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r.text for r in history.within_budget(rows, 50).collect()}
    assert got[1].endswith("…[truncated]") and len(got[1]) < 250 and got[2] == "short"


def test_distant_turns_can_be_fetched_from_the_cache(spark):
    rows = spark.createDataFrame([(1, k, "user", f"a long enough turn number {k}") for k in range(6)], "conv_id long, turn long, role string, text string")
    pruned = history.prune_history(rows, "afm", keep_last=1, thematic=1)
    cache = state.cache_put(None, history.distant_payloads(rows, 1, 1), now=1)
    whole = history.rendered_history(pruned)
    got = state.cache_get(cache, whole.select(F.col("distant_key").alias("key")), 2).first()
    assert got.hit and got.content.startswith("user: a long enough turn number 0\n") and "number 3" in got.content and "number 4" not in got.content
    assert whole.first().rendered.endswith("user: a long enough turn number 5\n")


def test_rerank_numbers_and_metrics(spark):
    d = docs(spark, *[f"alpha {'beta ' * (i % 7)}" for i in range(300)], None)
    hits = ranking.rerank(d, "alpha beta")
    rows = hits.collect()
    assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1)) and [(-r.score, r.doc_id) for r in rows] == sorted((-r.score, r.doc_id) for r in rows)
    m = ranking.rerank_metrics(d, hits).first()
    assert (m.candidates, m.hits) == (301, len(rows)) and m.original_tokens > 0
    one = ranking.bm25_scores(d, "alpha beta", keep=["doc_id"])
    assert {(r.doc_id, r.bm25_score) for r in one.collect()} == {(r.doc_id, r.bm25_score) for r in ranking.bm25(d, "alpha beta").collect()}
    assert ranking.rerank(d, "alpha", top_k=2, include_text=True).first().text.startswith("alpha")
