"""Counting policies, rollups, comparison, history, warnings, sinks."""

import json
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from linescope.functions import text as T
from linescope.operators import delta, history, preview, rollup, submodules
from linescope.operators import warnings as W
from linescope.operators.counts import effective_counts
from linescope.plans.analyze import analyze_files
from linescope.schemas import EFFECTIVE, FILE_RECORDS, RAW, RUNS
from linescope.sinks import runs as sinks
from linescope.sources import runs as R
from linescope.sources.files import from_table

RAW_NAMES = [part.split(":")[0] for part in RAW[7:-1].split(",")]


def test_counting_policies(spark):
    def counts(policy, docs=True, **given):
        raw = F.struct(*[F.lit(given.get(n, 0)).cast("bigint").alias(n) for n in RAW_NAMES])
        row = spark.range(1).select(raw.alias("raw")).select(effective_counts(F.col("raw"), policy, docs).alias("e"))
        return tuple(row.first().e)

    first = dict(code_only_lines=2, single_comment_only_lines=1, mixed_code_single_comment_lines=3,
                 docstring_comment_lines=2)
    assert counts("code_only", **first) == (5, 3, 0, 0)
    assert counts("code_only", False, **first) == (7, 1, 0, 0)
    assert counts("code_and_comment", **first) == (5, 6, 0, 0)
    assert counts("comment_only", **first) == (2, 6, 0, 0)
    second = dict(mixed_code_single_comment_lines=2, mixed_code_multi_comment_lines=1)
    assert counts("separate_mixed_category", **second) == (0, 0, 0, 3)


def record(path, code=0, comment=0, blank=0, mixed=0, language="C", status="analyzed_exact", full=None, warnings=()):
    raw = (code + comment + blank + mixed, blank, code, comment, 0, mixed, 0, 0, 0)
    return ("run", full or "/w/" + path, path, language, 1, "utf-8", raw, (code, comment, blank, mixed), status,
            list(warnings), False, False, False, "lexical", None)


def frame(spark, rows):
    return spark.createDataFrame(rows, FILE_RECORDS)


def test_file_delta(spark):
    base = frame(spark, [record("same", 1), record("mix", 1), record("mod", 5, 1), record("gone", 3),
                         record("twice", 1, full="/a/twice"), record("twice", 9, full="/b/twice")])
    cur = frame(spark, [record("same", 1), record("mix", 1, mixed=4), record("mod", 2, 4), record("new", 7, 1, 2),
                        record("twice", 9), record("twice", 10)])
    deltas = delta.file_delta(base, cur)
    got = sorted((r.relative_path, r.status, r.code_delta, r.total_delta) for r in deltas.collect())
    assert got == [("gone", "removed", -3, -3), ("mix", "unchanged", 0, 0), ("mod", "modified", -3, 0),
                   ("new", "added", 7, 10), ("same", "unchanged", 0, 0), ("twice", "modified", 1, 1),
                   ("twice", "unchanged", 0, 0)]
    assert delta.line_churn(deltas).first().asDict() == {
        "lines_added": 8, "lines_removed": 6, "lines_unmodified": 11, "lines_net": 2,
    }
    assert [r.relative_path for r in delta.sort_deltas(deltas).collect()][:4] == ["mod", "twice", "new", "gone"]
    assert tuple(delta.path_sets(base, cur).first()) == (1, 1, 4)
    assert delta.top_changed(deltas, 2).count() == 2


def test_rollups_and_submodules(spark):
    rows = frame(spark, [record("libs/a/x.c", 3), record("libs/a/y.py", 2, language="Python", mixed=1),
                         record("libs/ab/z.c", 1), record("skip", status="skipped_binary", language=None,
                                                          warnings=["w1", "w2"])])
    text = ('path = lost\n[submodule "a"]\n\tpath = old\n\tpath = libs/a\n[submodule "none"]\n url = x\n'
            '  [submodule "late"]  \npath=libs\n')
    subs = submodules.parse_gitmodules(spark.createDataFrame([("run", text)], "run_id string, text string"), "run_id")
    assert [(r.ord, r["name"], r.path) for r in subs.orderBy("ord").collect()] == [(1, "a", "libs/a"), (3, "late", "libs")]
    tagged = submodules.tag_submodule(rows, subs, "run_id")
    assert {r.relative_path: r.submodule for r in tagged.collect()} == {
        "libs/a/x.c": "a", "libs/a/y.py": "a", "libs/ab/z.c": "late", "skip": None,
    }
    totals = {r.submodule: (r.relative_path, r.files_analyzed, r.code_lines) for r in
              rollup.submodule_totals(tagged, subs).collect()}
    assert totals == {"a": ("libs/a", 2, 5), "late": ("libs", 1, 1)}
    assert rollup.submodule_run(tagged, subs, "a").first().mixed_lines_separate == 0
    assert tuple(rollup.run_totals(rows).first()) == (4, 3, 1, 7, 6, 0, 0, 1)
    languages = [(r.language, r.files) for r in rollup.language_totals(rows).orderBy("enum_order").collect()]
    assert languages == [("C", 2), ("Python", 1)]
    gate = {r.check: (r.exit_code, r.passed, r.value) for r in rollup.quality_gate(rows, True, 6).collect()}
    assert gate == {"no_warnings": (2, False, 2), "code_lines": (3, True, 6)}


def history_frame(spark, rows):
    base = datetime(2024, 1, 1)
    data = [
        (run, base + timedelta(minutes=minute), "p", [root], f"/out/{run}/result.json", html, None, n, 0, n, n, 0, 0,
         None, None, None, None, None)
        for run, minute, root, n, html in rows
    ]
    return spark.createDataFrame(data, RUNS)


def test_sliced_history_matches_a_plain_walk(spark):
    rnd = random.Random(5)
    # One project holds most runs, many within one hour.
    rows = [(f"r{n:04d}", rnd.choice([rnd.randint(0, 50), rnd.randint(0, 5000)]),
             rnd.choice(["hot", "hot", "hot", "b", "c"]), rnd.randint(0, 99), None) for n in range(600)]
    runs = history_frame(spark, rows)
    gone = {run for run, *_ in rows if rnd.random() < 0.3}  # runs whose JSON was deleted
    here = spark.createDataFrame([(f"/out/{run}/result.json",) for run, *_ in rows if run not in gone], "path string")
    numbers = {r.run_id: r.scan_number for r in history.scan_number(runs, here).collect()}
    changes = {r.run_id: (r.prev_code_lines, r.code_lines_change) for r in history.run_change(runs, here).collect()}
    earlier = {r.run_id: r.prev_run_id for r in history.prev_run(runs, here).collect()}
    seen = {}
    for run, _, root, n, _ in sorted(rows, key=lambda r: (r[1], r[0])):
        before = seen.setdefault(root, [])
        assert numbers[run] == len(before) + 1
        assert changes[run] == ((before[-1][1], n - before[-1][1]) if before else (None, None))
        assert earlier[run] == (before[-1][0] if before else None)
        if run not in gone:
            before.append((run, n))


def test_history_operators(spark):
    runs = history_frame(spark, [("20240101-0000-a", 0, "/p", 5, None), ("20240101-0100-b", 60, "/p", 7, "/o/x.html"),
                                 ("20240101-0200-c", 120, "/q", 1, None)])
    here = spark.createDataFrame([("/out/20240101-0000-a/result.json",), ("/out/20240101-0200-c/result.json",),
                                  ("/o/report.pdf",)], "path string")
    assert {r.run_id[-1] for r in history.prune_stale(runs, here).collect()} == {"a", "c"}
    assert {r.run_id[-1]: r.prev_run_id for r in history.prev_run(runs, here).collect()} == {
        "a": None, "b": "20240101-0000-a", "c": None,
    }
    pdf = {r.run_id[-1]: r.pdf_path for r in history.artifact_lookup(runs, here).collect()}
    assert pdf == {"a": None, "b": "/o/report.pdf", "c": None}
    assert history.run_metrics(runs).first().run_id.endswith("c")
    assert history.order_pair(runs, "20240101-0100-b", "20240101-0000-a").first().baseline_run_id.endswith("a")
    new = runs.where(F.col("code_lines") == 5).withColumn("code_lines", F.lit(50).cast("bigint"))
    assert {r.code_lines for r in history.register_run(runs, new).collect()} == {50, 7, 1}
    past = history.project_history(runs, "/p").first()
    assert (past.scan_count, past.last_scan_timestamp) == (2, "2023-12-31 17:00 PST")
    rows = {r.run_id_short: (r.timestamp, r.has_json) for r in history.history_rows(runs, here).collect()}
    assert rows["b"] == ("2023-12-31 17:00 PST", False)
    assert history.badge_value(runs).count() == 4 and history.run_metrics(runs.limit(0)).count() == 0
    assert [r.run_id[-1] for r in history.paginate(history.runs_newest_first(runs), 2, 2).collect()] == ["a"]


def test_warnings(spark):
    rows = frame(spark, [record(f"f{n:03d}.md", status="skipped_unsupported",
                                warnings=["unsupported or undetected language"]) for n in range(1200)])
    warned = W.run_warnings(rows)
    lines = {r.number: r.line for r in W.number_console(warned.repartition(6)).collect()}
    assert len(lines) == 1200 and lines[1].startswith("[001] f000.md: ") and lines[1200].startswith("[1200] ")
    assert sorted(lines) == list(range(1, 1201))
    preview_rows = W.warning_preview(warned).collect()
    assert len(preview_rows) == 12 and preview_rows[0].total == 1200 and preview_rows[0].truncated
    assert [(r.label, r["count"]) for r in W.support_opportunities(warned).collect()] == [("Documentation / text", 1200)]
    assert W.warning_buckets(warned).first()["count"] == 1200


def test_preview_tree(spark):
    df = spark.createDataFrame([(p,) for p in ("b/x.py", "A/y.md", "a.c", ".git/z", "n/node_modules/q/r", "skip/s.c")],
                               "relative_path string")
    rows = preview.preview_tree(df, exclude=["skip/*"]).collect()
    assert [r["name"] for r in rows] == [".git/", "A/", "y.md", "a.c", "b/", "x.py", "n/", "node_modules/"]
    assert [r["name"] for r in preview.preview_tree(df, exclude=["skip/*"], max_depth=1, max_rows=3).collect()] == [
        ".git/", "A/", "a.c",
    ]
    mixed = spark.createDataFrame([(p,) for p in ("A/c.c", "a/b.c", "A/x.c")], "relative_path string")
    assert [r.relative_path for r in preview.preview_tree(mixed).collect()] == ["A", "A/c.c", "A/x.c", "a", "a/b.c"]
    stats = preview.preview_stats(preview.preview_rows(df)).first()
    assert (stats.directories, stats.supported, stats.unsupported, stats.languages) == (6, 3, 1, "C,Python")


def test_sinks_round_trip(spark, tmp_path):
    files = from_table(spark.createDataFrame(
        [("/w/a,b.c", b"int a; // x\n"), ("/w/q.py", b'"""d"""\n'), ("/w/n.md", b"x")], "path string, content binary"), "/w")
    rows = analyze_files(files, run_id="r1")
    sinks.write_run_csv(rows, str(tmp_path / "csv"), "r1", datetime(2024, 1, 2, 3, 4, 5), "T")
    text = "".join(p.read_bytes().decode() for p in sorted((tmp_path / "csv/per_file").glob("*.csv")))
    assert text.startswith("Path,Language,Size (bytes),Code Lines,Comment Lines,Blank Lines,Physical Lines,Generated,"
                           'Minified,Vendor\r\n') and '"a,b.c",C,12,1,0,0,1,false,false,false\r\n' in text
    summary = "".join(p.read_text() for p in (tmp_path / "csv/summary").glob("*.csv"))
    assert "Timestamp,2024-01-02 03:04:05 UTC" in summary and "Files Skipped,1" in summary
    sinks.write_run_tables(rows, str(tmp_path / "tables"))
    assert spark.read.parquet(str(tmp_path / "tables/file_records")).count() == 3
    deltas = delta.file_delta(rollup.analyzed(rows), rollup.analyzed(rows))
    runs = history_frame(spark, [("r0", 0, "/w", 1, None), ("r1", 1, "/w", 4, None)])
    change = delta.summary_delta(runs, "r0", "r1")
    assert change.first().code_lines_delta == 3
    sinks.write_diff_csv(change, deltas, str(tmp_path / "diff"))
    assert "Files Unchanged,2" in "".join(p.read_text() for p in (tmp_path / "diff/summary").glob("*.csv"))
    sinks.write_diff_json(change, deltas, str(tmp_path / "diffjson"))
    assert spark.read.json(str(tmp_path / "diffjson/file_deltas")).count() == 2


def test_saved_run_json(spark, tmp_path):
    counts = dict.fromkeys(["files_considered", "files_analyzed", "files_skipped", "total_physical_lines", "code_lines",
                            "comment_lines", "blank_lines", "mixed_lines_separate"], 1)
    effective = dict.fromkeys([part.split(":")[0] for part in EFFECTIVE[7:-1].split(",")], 1)
    file = {"path": "/w/a", "relative_path": "a", "language": "c_sharp", "size_bytes": 3, "detected_encoding": "utf-8",
            "raw_line_categories": dict.fromkeys(RAW_NAMES, 1), "effective_counts": effective,
            "status": "analyzed_exact", "warnings": [], "generated": False, "minified": False, "vendor": False,
            "parse_mode": "lexical"}
    run = {"tool": {"name": "t", "version": "1", "run_id": "r9", "timestamp_utc": "2024-01-01T00:00:00.5Z"},
           "input_roots": ["/w"], "summary_totals": counts, "per_file_records": [file], "skipped_file_records": [],
           "totals_by_language": [{"language": "objective_c", "files": 1, "code_lines": 4}], "warnings": []}
    (tmp_path / "run.json").write_text(json.dumps(run, indent=2))
    saved = R.read_run_json(spark, str(tmp_path / "run.json"))
    row = R.run_files(saved).first()
    assert (row.run_id, row.language, row.raw.blank_only_lines, row.submodule) == ("r9", "C#", 1, None)
    assert R.run_languages(saved).first().language == "Objective-C"
    assert saved.first().git_branch is None
    assert R.read_registry(spark, str(tmp_path / "missing")).count() == 0


def test_text_functions(spark):
    row = spark.range(1).select(
        T.project_label(F.lit("/a/My Proj_1/")).alias("a"), T.project_label(F.lit("/__/")).alias("b"),
        T.truncate_text(F.lit("abcdef"), 4).alias("c"), T.csv_quote(F.lit('a"b')).alias("d"),
        T.signed_text(F.lit(-3)).alias("e"), T.signed_text(F.lit(3)).alias("f"), T.epoch_minute_text(F.lit(-1)).alias("g"),
        T.html_escape(F.lit("<a'&\">")).alias("h"), T.format_thousands(F.lit(1234567)).alias("i"),
        T.code_ratio_pct(F.lit(0), F.lit(0), F.lit(0)).alias("j"), T.rfc3339(F.lit(datetime(2024, 1, 1, 0, 0, 0, 500000))).alias("k"),
        T.change_text(F.lit(1), F.lit(None).cast("int")).alias("l"),
    ).first()
    assert tuple(row) == ("my-proj-1", "project", "abc…", '"a""b"', "-3", "+3", "-", "&lt;a&#39;&amp;&quot;&gt;",
                          "1,234,567", 0, "2024-01-01T00:00:00.500+00:00", "—")
    assert sinks.run_id(datetime(2024, 1, 2, 3, 4)).startswith("20240102-0304-")
