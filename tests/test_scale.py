"""What large and skewed inputs need: tasks of equal bytes, one pass for all
totals, comparisons that move nothing, gates and pages without extra reads."""

import random
import statistics
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from linescope.operators import delta, history, rollup, submodules
from linescope.operators.gate import Gate, GateError
from linescope.operators.pages import Pages, save_sorted
from linescope.plans.analyze import analyze_files
from linescope.settings import Settings
from linescope.sinks import runs as sinks
from linescope.sources.files import from_table, spread_bytes


def files(spark, entries, root="/w"):
    return from_table(spark.createDataFrame(entries, "path string, content binary"), root)


def records(spark, entries, run="r", **options):
    return analyze_files(files(spark, entries), run_id=run, **options)


def plan(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


# ---- tasks of equal bytes ---------------------------------------------------------------


def test_spread_bytes(spark):
    rng = random.Random(1)
    sizes = [2 << 20] * 9 + [rng.randrange(100, 4000) for _ in range(4000)] + [0, 0]
    rng.shuffle(sizes)
    table = spark.createDataFrame([(f"/w/d{k % 50}/f{k}.c", n) for k, n in enumerate(sizes)], "path string, size_bytes bigint")
    dealt = spread_bytes(table, 8).withColumn("task", F.spark_partition_id())
    held = {r.task: (r.n, r.bytes) for r in dealt.groupBy("task").agg(F.count("*").alias("n"), F.sum("size_bytes").alias("bytes")).collect()}
    assert len(held) == 8 and sum(n for n, _ in held.values()) == len(sizes)
    assert max(b for _, b in held.values()) <= 2 * statistics.median(b for _, b in held.values())
    by_rows = [sum(sizes[k::8]) for k in range(8)]
    assert sorted(r.path for r in dealt.collect()) == sorted(r.path for r in table.collect()) and sum(by_rows) == sum(sizes)


def test_spread_bytes_of_odd_tables(spark):
    empty = spark.createDataFrame([], "path string, size_bytes bigint")
    assert spread_bytes(empty, 4).collect() == []
    odd = spark.createDataFrame([(None, 5), ("/a", None), ("/a", None)], "path string, size_bytes bigint")
    assert spread_bytes(odd, 4).count() == 3


# ---- totals from one pass ---------------------------------------------------------------


@pytest.fixture(scope="module")
def tagged(spark):
    rng = random.Random(2)
    kinds = [("a.py", b"x = 1 # c\n"), ("b.c", b"int a;\n// c\n\n"), ("c.bin", b"\x00"), ("d.unknown", b"?"), ("e.sql", b"select 1;\n")]
    entries = [(f"/w/{rng.choice(['', 'libs/one/', 'libs/one/in/', 'two/'])}d{k}/{name}", body) for k in range(60) for name, body in [rng.choice(kinds)]]
    half = F.when(F.crc32("path") % 2 == 0, "r1").otherwise("r2")
    subs = spark.createDataFrame([(r, n, name, path) for r in ("r1", "r2") for n, (name, path) in enumerate([("one", "libs/one"), ("in", "libs/one/in"), ("two", "two")])], "run_id string, ord int, name string, path string")
    return submodules.tag_submodule(records(spark, entries, run=half), subs, "run_id").cache(), subs


def same(a, b):
    assert a.columns == b.columns
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


def test_levels_equal_the_single_totals(tagged):
    rows, subs = tagged
    every = rollup.all_totals(rows, "run_id")
    own = subs.drop("run_id").distinct()
    same(rollup.run_level(every, "run_id"), rollup.run_totals(rows, "run_id"))
    same(rollup.language_level(every, "run_id"), rollup.language_totals(rows, "run_id"))
    same(rollup.submodule_level(every, own, "run_id"), rollup.submodule_totals(rows, own, "run_id"))
    same(rollup.submodule_language_level(every, "run_id"), rollup.submodule_language_totals(rows, "run_id"))
    same(rollup.run_level(rollup.all_totals(rows)), rollup.run_totals(rows))


def test_levels_take_one_scan_and_one_shuffle(spark, tagged, tmp_path):
    rows, _ = tagged
    saved = sinks.save_records(rows, str(tmp_path / "r"))
    text = plan(rollup.all_totals(saved, "run_id"))
    assert text.count("FileScan parquet") == 1 and text.count("Exchange") == 1


# ---- submodules -------------------------------------------------------------------------


def test_many_submodules_enter_no_array(spark):
    """Each file meets one row a depth; the first in file order wins."""
    rng = random.Random(3)
    many = [(k, f"m{k}", "/".join(rng.choices("abcdefgh", k=rng.randrange(1, 5)))) for k in range(3000)]
    many += [(3000, "back", "q\\r"), (3001, "slash", "s/"), (-1, "first", "a/b")]
    paths = {"/".join(rng.choices("abcdefgh", k=rng.randrange(1, 7))) for _ in range(400)} | {"q/r/x", "s/x", "zz", "a/b", "a/bc/d"}
    rows = spark.createDataFrame([("run", p) for p in sorted(paths)], "run_id string, relative_path string").withColumn("submodule", F.lit("old"))
    subs = spark.createDataFrame([("run", *m) for m in many], "run_id string, ord int, name string, path string")
    found = submodules.tag_submodule(rows, subs, "run_id")
    assert found.columns == rows.columns and "collect_list" not in plan(found)

    def holder(path):
        held = [(n, name) for n, name, p in many if path == p.replace("\\", "/") or path.startswith(p.replace("\\", "/") + "/")]
        return min(held)[1] if held else None

    assert {r.relative_path: r.submodule for r in found.collect()} == {p: holder(p) for p in paths}


def test_no_submodules(spark):
    rows = spark.createDataFrame([("run", "a/b")], "run_id string, relative_path string").withColumn("submodule", F.lit("old"))
    none = spark.createDataFrame([], "run_id string, ord int, name string, path string")
    assert [tuple(r) for r in submodules.tag_submodule(rows, none, "run_id").collect()] == [("run", "a/b", None)]


# ---- comparisons without an exchange ----------------------------------------------------


def two_runs(spark):
    rng = random.Random(4)
    base = [(f"/w/d{k % 7}/f{k}.py", b"x = 1\n" * rng.randrange(1, 9)) for k in range(120)]
    cur = [(p, b + (b"# c\n" if rng.random() < 0.3 else b"")) for p, b in base[20:]] + [(f"/w/n{k}.py", b"y\n") for k in range(9)]
    return records(spark, base, "base").unionByName(records(spark, cur, "cur"))


def test_bucketed_runs_are_compared_in_place(spark, tmp_path):
    rows = sinks.save_records(two_runs(spark), str(tmp_path / "plain"))
    path = str(tmp_path / "buckets")
    for run in ("base", "cur"):
        sinks.save_bucketed(rows, path, run, buckets=4)
    base, cur = (rollup.analyzed(sinks.open_bucketed(spark, path, run, buckets=4)) for run in ("base", "cur"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        compared = delta.file_delta(base, cur)
        assert "Exchange" not in plan(compared)
        assert "Exchange" not in plan(delta.removed_files(base, cur))
        of = lambda run: rollup.analyzed(rows).where(F.col("run_id") == run)
        same(compared, delta.file_delta(of("base"), of("cur")))
        assert plan(delta.path_sets(base, cur)).count("Exchange") <= 2  # the final counts
        same(delta.path_sets(base, cur), delta.path_sets(of("base"), of("cur")))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_a_bucketed_run_saved_again_replaces_its_rows(spark, tmp_path):
    path = str(tmp_path)
    first = records(spark, [("/w/a.py", b"x\n"), ("/w/b.py", b"x\n")], "r")
    sinks.save_bucketed(first, path, "r", 2)
    again = sinks.save_bucketed(records(spark, [("/w/c.py", b"x\n")], "r"), path, "r", 2)
    assert [r.relative_path for r in again.collect()] == ["c.py"]
    name = sinks._bucketed_name(path, "r", 2)
    spark.sql(f"drop table {name}")  # as a new session, which knows the folder alone
    assert [r.relative_path for r in sinks.open_bucketed(spark, path, "r", 2).collect()] == ["c.py"]


# ---- gate -------------------------------------------------------------------------------


ODD = [("/w/a.c", b"\x00"), ("/w/b.c", b"\x00"), ("/w/c.c", b"\xef\xbb\xbf\xff"), ("/w/d.c", b"int a;\n"), ("/w/e.unknown", b"?")]


def test_gate_names_all_that_failed(spark, tmp_path):
    settings = Settings().updated(analysis={"binary_file_behavior": "fail", "decode_failure_behavior": "fail"})
    gate = Gate(settings, fail_on_warnings=True, fail_below=2)
    jobs = spark.sparkContext.statusTracker()
    before = len(jobs.getJobIdsForGroup(None))
    saved = sinks.save_records(records(spark, ODD, settings=settings, stop_early=False), str(tmp_path / "r"), gate)
    written = len(jobs.getJobIdsForGroup(None))
    checks = {c.check: c for c in gate.checks()}
    with pytest.raises(GateError, match="no_binary_files: 2, limit 0; no_decode_errors: 1, limit 0; no_warnings: 4, limit 0; code_lines: 1, limit 2") as failed:
        gate.enforce()
    assert len(jobs.getJobIdsForGroup(None)) == written > before  # the gate ran no job
    assert failed.value.exit_code == 1 and [c.exit_code for c in failed.value.failed] == [1, 1, 2, 3]
    plain = {r.check: r for r in rollup.quality_gate(saved, True, 2).collect()}
    assert {name: (r.exit_code, r.passed, r.value, r.limit) for name, r in plain.items()} == {
        name: tuple(checks[name])[1:] for name in plain
    }


def test_gate_passes(spark, tmp_path):
    gate = Gate(fail_below=1)
    sinks.save_records(records(spark, ODD), str(tmp_path / "r"), gate)
    gate.enforce()
    assert [c.check for c in gate.checks()] == ["code_lines"]
    none = Gate(fail_on_warnings=True, fail_below=0)
    sinks.save_records(records(spark, ODD).limit(0), str(tmp_path / "none"), none)
    none.enforce()
    with pytest.raises(ValueError):
        Gate().checks()


# ---- pages ------------------------------------------------------------------------------


def history_table(spark):
    rng = random.Random(5)
    rows = [(f"r{k:04}", rng.choice(["Ab", "aB", "é", "Z", "", None]), rng.choice([None, *range(12)]), datetime(2024, 1, rng.randrange(1, 28), tzinfo=timezone.utc)) for k in range(500)]
    return spark.createDataFrame(rows, "run_id string, label string, code bigint, at timestamp")


@pytest.mark.parametrize("column", ["label", "code", "at"])
@pytest.mark.parametrize("ascending", [True, False])
def test_pages_equal_the_offset(spark, tmp_path, column, ascending):
    table = history_table(spark)
    save_sorted(table, str(tmp_path), column, "run_id", ascending, ranges=7)
    pages = Pages(spark, str(tmp_path), ascending)
    whole = [tuple(r) for r in history.table_sort(table, column, "run_id", ascending).collect()]
    assert len(pages.ranges) > 1
    at = table.columns.index(column)
    for number in (1, 2, 9, 20, 21):
        want = whole[(number - 1) * 25 : number * 25]
        assert [tuple(r) for r in pages.page(number).collect()] == want
        if want:
            seen = want[-1][at]
            key = seen.lower() if isinstance(seen, str) else seen
            assert [tuple(r) for r in pages.after(key, want[-1][0]).collect()] == whole[number * 25 : number * 25 + 25]


def test_a_page_reads_its_ranges_alone(spark, tmp_path):
    table = history_table(spark)
    save_sorted(table, str(tmp_path), "code", "run_id", ranges=9)
    pages = Pages(spark, str(tmp_path))
    page = pages.page(2)
    files_read = page.inputFiles()
    text = plan(page)
    assert "PartitionFilters" in text and "_place" in text.split("PushedFilters")[1]
    held = {r.number for r in pages.ranges if r.start < 50 and r.start + r.rows > 25}
    scanned = page.select(F.input_file_name().alias("f")).distinct().collect()
    assert len(scanned) <= len(held) < len(pages.ranges) <= len(files_read) or len(files_read) <= len(held)
    # The last row that was seen may be gone.
    assert [r.run_id for r in pages.after(3, "r9999").collect()][0] == [r.run_id for r in history.table_sort(table.where("code > 3"), "code", "run_id").limit(1).collect()][0]
    assert pages.after(99, "r").collect() == [] and pages.page(99).collect() == []


def test_pages_of_an_empty_table(spark, tmp_path):
    save_sorted(history_table(spark).limit(0), str(tmp_path), "code", "run_id")
    pages = Pages(spark, str(tmp_path))
    assert pages.page(1).collect() == [] and pages.after(1, "a").collect() == []
