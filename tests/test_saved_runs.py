"""Large run documents read in ranges, and the versioned history."""

import json
import random

import pytest
from pyspark.sql import functions as F

from linescope.operators.history import register_run
from linescope.schemas import EFFECTIVE, RAW, RUNS
from linescope.sinks import runs as sinks
from linescope.sources import documents
from linescope.sources import runs as R
from linescope.versions import drop_versions, latest_version, write_version

RAW_NAMES = [part.split(":")[0] for part in RAW[7:-1].split(",")]
COUNT_NAMES = [part.split(":")[0] for part in EFFECTIVE[7:-1].split(",")]


def run_document(seed, files, warnings=5):
    """A run whose strings hold every mark of JSON."""
    rng = random.Random(seed)
    odd = lambda: "".join(rng.choices('abc ,:{}[]"\\\n\té…', k=rng.randrange(0, 25)))
    record = lambda k: {
        "path": f"/w/{odd()}{k}", "relative_path": f"{k}", "language": rng.choice(["python", "c_sharp", None]), "size_bytes": k,
        "detected_encoding": odd(), "raw_line_categories": {n: rng.randrange(9) for n in RAW_NAMES},
        "effective_counts": {n: rng.randrange(9) for n in COUNT_NAMES}, "status": "analyzed_exact",
        "warnings": [odd() for _ in range(rng.randrange(3))], "generated": False, "minified": rng.random() < 0.5, "vendor": False, "parse_mode": "lexical",
    }
    return {
        "tool": {"name": "t, {", "version": odd(), "run_id": f"run {seed}", "timestamp_utc": "2024-01-01T00:00:00.5Z"},
        "environment": {"operating_system": odd()},
        "effective_configuration": {"a": [1, {"b": odd()}]},
        "input_roots": ["/w", odd() + "x"],
        "summary_totals": {"files_considered": files, "code_lines": 3},
        "totals_by_language": [{"language": n, "files": k, "code_lines": 4} for k, n in enumerate(["c", "objective_c", "rust"])],
        "per_file_records": [record(k) for k in range(files)],
        "skipped_file_records": [record(-k) for k in range(1, rng.randrange(1, 4))],
        "warnings": [odd() for _ in range(warnings)],
        "submodule_summaries": [],
        "git_branch": 'ma"in,', "git_commit_author": None,
    }


def same(spark, path):
    runs, files, warnings = documents.read_run_documents(spark, path)
    whole = R.read_run_json(spark, path)
    plain = R.run_files(whole)
    key = lambda rows: sorted((repr(r.asDict(True)) for r in rows))
    assert key(files.select(plain.columns).collect()) == key(plain.collect())
    both = [name for name in runs.columns if name in whole.columns]
    assert key(runs.select(both).collect()) == key(whole.select(both).collect())
    said = whole.select(F.col("tool.run_id").alias("run_id"), F.explode("warnings").alias("warning"))
    assert key(warnings.collect()) == key(said.collect())
    return runs


@pytest.mark.parametrize("bytes_, indent", [(211, None), (1000, 2), (100_000_000, None)])
def test_documents_in_ranges(spark, tmp_path, indent, bytes_):
    """Ranges of any size give the rows that the whole document gives."""
    for seed, files in enumerate((0, 1, 12)):
        (tmp_path / f"{seed}.json").write_text(json.dumps(run_document(seed, files), indent=indent, ensure_ascii=seed == 1))
    before = {name: spark.conf.get(name) for name in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", bytes_)
    spark.conf.set("spark.sql.files.openCostInBytes", 0 if bytes_ < 1000 else 10)
    try:
        runs = same(spark, str(tmp_path))
        configured = {r.tool.run_id: json.loads(r.effective_configuration) for r in runs.collect()}
        assert configured["run 1"]["a"][0] == 1
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


@pytest.mark.parametrize("buffer", [1, 7, 64, 1000])
def test_walker_with_any_buffer(monkeypatch, buffer):
    """Marks, names and texts do not depend on where a buffer ends."""
    monkeypatch.setattr(documents, "BUFFER", buffer)
    text = json.dumps(run_document(4, 6), indent=1)
    whole = []
    walker = documents.Walker(False)
    for k, part in enumerate(text.split(",")):
        for token, before in walker.feed(part if k == 0 else "," + part):
            whole.append((token, before))
            walker.move(token)
    for token, before in walker.feed("", last=True):
        whole.append((token, before))
        walker.move(token)
    assert walker.frames == [] and walker.closed == 0
    assert sum(token == "{" for token, _ in whole) == sum(t == "}" for t, _ in whole)
    names = {token.strip('"') for token, _ in whole if token[0] == '"'}
    assert set(run_document(4, 6)) <= names and "raw_line_categories" in names


def row(spark, run, code, when="2024-01-01 00:00:00"):
    names = [part.split(" ")[0] for part in RUNS.split(", ")]
    values = dict.fromkeys(names) | {"run_id": run, "code_lines": code, "input_roots": ["/w"]}
    return spark.createDataFrame([tuple(values[n] for n in names)], RUNS).withColumn("timestamp_utc", F.lit(when).cast("timestamp"))


def held(spark, path, version=None):
    return sorted((r.run_id, r.code_lines) for r in R.read_registry(spark, path, version).collect())


def test_interleaved_writers_keep_both_runs(spark, tmp_path):
    path = str(tmp_path / "history")
    sinks.add_runs(spark, path, row(spark, "a", 1))
    calls = []

    def slow(runs):
        calls.append(held(spark, path))
        if len(calls) == 1:  # another writer comes first
            sinks.add_runs(spark, path, row(spark, "b", 2))
        return register_run(runs, row(spark, "c", 3))

    assert sinks.update_registry(spark, path, slow) == 3
    assert calls == [[("a", 1)], [("a", 1), ("b", 2)]]
    assert held(spark, path) == [("a", 1), ("b", 2), ("c", 3)]
    assert held(spark, path, 1) == [("a", 1)]


def test_readers_see_whole_versions(spark, tmp_path):
    path = str(tmp_path / "history")
    assert held(spark, path) == [] and latest_version(spark, path) == 0
    sinks.save_registry(row(spark, "a", 1), path)
    early = R.read_registry(spark, path)
    grown = register_run(early, row(spark, "a", 5))  # reads the path that it is saved to
    assert sinks.save_registry(grown, path) == 2
    assert sorted((r.run_id, r.code_lines) for r in early.collect()) == [("a", 1)]
    assert held(spark, path) == [("a", 5)]
    assert not write_version(row(spark, "x", 9), path, 2)  # the number is taken
    assert held(spark, path) == [("a", 5)] and len(list((tmp_path / "history" / "data").iterdir())) == 2
    # A writer that dies before its marker is in place leaves no trace for readers.
    row(spark, "lost", 0).write.parquet(f"{path}/data/unfinished")
    assert held(spark, path) == [("a", 5)]
    drop_versions(spark, path, keep=1)
    assert held(spark, path) == [("a", 5)] and latest_version(spark, path) == 2


def test_a_writer_gives_up(spark, tmp_path):
    path = str(tmp_path / "history")
    sinks.save_registry(row(spark, "a", 1), path)

    def beaten(runs):
        sinks.save_registry(row(spark, "b", 2), path)
        return runs

    with pytest.raises(RuntimeError):
        sinks.update_registry(spark, path, beaten, attempts=2)
    assert held(spark, path) == [("b", 2)]


def test_plain_folder_is_still_read(spark, tmp_path):
    row(spark, "old", 1).write.parquet(str(tmp_path / "plain"))
    assert held(spark, str(tmp_path / "plain")) == [("old", 1)]
