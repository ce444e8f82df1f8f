"""Registered queries against DuckDB on the smallest tables, plan checks, grids and caches."""
import math

import pytest

duckdb = pytest.importorskip("duckdb")
from pyspark.sql import functions as F

from plumbline import audit, profile_table
from plumbline.checks import all_checks
from plumbline.checks.base import dirty_lines
from plumbline.operators.samplers import random_uniform
from plumbline.plans import experiments, results
from plumbline.sources import cache, catalog, versions

TABLES = "nation region customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHECKS = all_checks()
SMALL = ["quality_profile", "quality_profile_dirty", "quality_profile_weighted", "row_flags", "error_proxy", "row_copies", "global_ordinal",
         "sample_uniform", "sample_importance", "sample_cluster", "sample_strat_column", "sample_mh", "sample_dag",
         "inject_duplicates", "inject_fd_per_key", "column_priority", "raftery_lewis", "generate_sensors", "ingest_log_lines", "clean_log",
         "progressive_curve", "accuracy_conditions", "resume_grid", "replace_merge", "replace_in_place", "inject_hundreds_of_copies",
         "profile_per_group", "missing_rate", "error_sweep", "robustness_sweep", "pairwise_weights_wide", "curve_converged"]


@pytest.fixture(scope="module")
def duck(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def _plain(rows):
    return sorted([tuple(None if isinstance(v, float) and math.isnan(v) else v for v in r) for r in rows], key=repr)


@pytest.mark.parametrize("name", SMALL)
def test_equals_sql(spark, folder, duck, name):
    df = CHECKS[name].run(spark, folder)
    columns = sorted(df.columns)
    ours = _plain([tuple(r[c] for c in columns) for r in df.collect()])
    result = duck.execute(CHECKS[name].sql)
    names = [d[0] for d in result.description]
    theirs = _plain([tuple(r[names.index(c)] for c in columns) for r in result.fetchall()])
    assert sorted(names) == columns
    assert ours == theirs


def test_plans_stay_in_the_jvm(spark, folder):
    t = dirty_lines(spark, folder)
    plan = profile_table(t)._jdf.queryExecution().executedPlan().toString()
    sampled = random_uniform(t, 0.1).df._jdf.queryExecution().executedPlan().toString()
    for text in (plan, sampled):
        assert "EvalPython" not in text and "CartesianProduct" not in text
    assert "Exchange" not in sampled and "Sort" not in sampled  # a sample is a filter


def test_profile_scans_only_measured_columns(spark, folder):
    t = audit(spark.read.parquet(f"{folder}/documents.parquet"), ["doc_id"], ["lang", "n_chars"], {"lang": "n_chars"})
    plan = profile_table(t)._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan.split("ReadSchema: ")[1].split("\n")[0]


def test_grid_is_resumed(spark, folder, tmp_path):
    t = dirty_lines(spark, folder)
    path = str(tmp_path / "results")
    first = experiments.run_grid({t.name: t}, ["random_uniform"], [0.1], [1, 2], path)
    assert first.count() == 2
    again = experiments.run_grid({t.name: t}, ["random_uniform", "exhaustive"], [0.1], [1, 2], path)
    assert again.count() == 4
    assert experiments.run_grid({t.name: t}, ["random_uniform", "exhaustive"], [0.1], [1, 2], path).count() == 4
    assert again.where("method = 'exhaustive' and rel_err_mean > 0").count() == 0


def test_prefix_scan_equals_single_runs(spark, folder):
    t = dirty_lines(spark, folder)
    truth = profile_table(t)
    together = experiments.prefix_results(t, ["random_uniform", "yamane"], [0.1], [42], truth)
    one = random_uniform(t, 0.1, 42).profile().first()
    row = together.where("method = 'random_uniform'").first()
    assert row["est_missing_rate"] == pytest.approx(one["missing_rate"]) and row["est_inconsistency_rate"] == pytest.approx(one["inconsistency_rate"])


def test_caches_are_keyed_by_parameters(spark, tmp_path):
    root = str(tmp_path)
    build = [spark.range(3), spark.range(5)]
    assert cache.cached_table(spark, root, "t", lambda: build[0], n=3).count() == 3
    assert cache.cached_table(spark, root, "t", lambda: build[1], n=3).count() == 3
    assert cache.cached_table(spark, root, "t", lambda: build[1], n=5).count() == 5
    assert cache.cached_table(spark, root, "t", lambda: build[1], force=True, n=3).count() == 5


def test_catalog(spark, folder):
    tables = catalog.folder_catalog(folder, {"events": {"key_cols": ("event_id",)}})
    t, truth = tables.load(spark, "events")
    assert t.rows == 1000 and truth is None
    with pytest.raises(ValueError):
        tables.load(spark, "absent")
    with pytest.raises(FileNotFoundError):
        catalog.first_existing(spark, [f"{folder}/absent.parquet"])


def test_half_even_report(spark):
    df = results.report_row(spark.createDataFrame([(0.0625, 0.00125)], "time_total_s double, acceptance_rate double"))
    assert tuple(df.first()) == (0.062, 0.0012)


def test_a_capped_table_has_its_own_truth(spark, folder, tmp_path):
    tables = catalog.folder_catalog(folder, {"events": {"key_cols": ("event_id",)}})
    whole = cache.truth_profile(tables.load(spark, "events")[0], str(tmp_path))
    part = cache.truth_profile(tables.load(spark, "events", n_records=100)[0], str(tmp_path))
    assert (whole.first()["sample_size"], part.first()["sample_size"]) == (1000, 100)


def test_tables_of_one_name_are_told_apart(spark, folder, tmp_path):
    t = dirty_lines(spark, folder)
    half = t.with_rows(t.df.where("l_linenumber = 1"))
    path = str(tmp_path / "grid")
    found = experiments.run_grid({"all": t, "first": half}, ["exhaustive"], [1.0], [1], path)
    assert {r["dataset"]: r["n_sampled"] for r in found.collect()} == {"all": t.rows, "first": half.rows}
    assert found.where("rel_err_mean > 0").isEmpty()
    assert experiments.run_grid({"all": t, "first": half}, ["exhaustive"], [1.0], [1], path).count() == 2


def test_a_failed_replacement_keeps_the_results(spark, tmp_path):
    path = str(tmp_path / "results")
    rows = spark.createDataFrame([("d", "a", 1.0), ("d", "b", 2.0)], "dataset string, method string, rel_err_mean double")
    results.write_results(rows, path)
    with pytest.raises(Exception):
        results.replace_results(rows.withColumn("rel_err_mean", F.raise_error(F.lit("no")).cast("double")), path, "a")
    assert results.read_results(spark, path).count() == 2
    results.replace_results(rows.where("method = 'a'").withColumn("rel_err_mean", F.lit(5.0)), path, "a")
    assert sorted((r["method"], r["rel_err_mean"]) for r in results.read_results(spark, path).collect()) == [("a", 5.0), ("b", 2.0)]


def _stored(spark, path):
    return sorted((r["method"], r["rel_err_mean"]) for r in results.read_results(spark, path).collect())


@pytest.mark.parametrize("step", ["write_folder", "commit", "half a manifest"])
def test_a_writer_may_die_at_any_step(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "results")
    rows = spark.createDataFrame([("d", "a", 1.0), ("d", "b", 2.0)], "dataset string, method string, rel_err_mean double")
    more = rows.where("method = 'a'").withColumn("rel_err_mean", F.lit(5.0))
    results.append_results(rows, path)
    real = {name: getattr(versions, name) for name in ("write_folder", "commit")}

    def dies(*arguments):
        if step == "half a manifest":
            (tmp_path / "results" / "log" / f"{arguments[2]:012d}.json").write_text('{"folders": ["data_f')
        elif step == "write_folder":
            real[step](*arguments)
        raise KeyboardInterrupt

    for write in (lambda: results.replace_results(more, path, "a"), lambda: results.append_results(more, path), lambda: results.write_results(more, path)):
        monkeypatch.setattr(versions, "write_folder" if step == "write_folder" else "commit", dies)
        with pytest.raises(KeyboardInterrupt):
            write()
        assert _stored(spark, path) == [("a", 1.0), ("b", 2.0)]
        for name, function in real.items():
            monkeypatch.setattr(versions, name, function)
    results.replace_results(more, path, "a")
    assert _stored(spark, path) == [("a", 5.0), ("b", 2.0)]
    assert versions.vacuum(spark, path) and _stored(spark, path) == [("a", 5.0), ("b", 2.0)]


def test_two_writers_lose_nothing(spark, tmp_path, monkeypatch):
    """Between the reading of a version and its commit another writer appends; many folders are compacted."""
    path = str(tmp_path / "results")
    rows = spark.createDataFrame([("d", "a", 1.0)], "dataset string, method string, rel_err_mean double")
    results.append_results(rows, path)
    real, other = versions.commit, [rows.withColumn("method", F.lit("b"))]

    def late(*arguments):
        if other:
            results.append_results(other.pop(), path)
        return real(*arguments)

    monkeypatch.setattr(versions, "commit", late)
    results.replace_results(rows.withColumn("rel_err_mean", F.lit(3.0)), path, "a")
    assert _stored(spark, path) == [("a", 3.0), ("b", 2.0 - 1.0)]
    monkeypatch.setattr(results, "MANY_FOLDERS", 2)
    for method in "cde":
        results.append_results(rows.withColumn("method", F.lit(method)), path)
    assert [m for m, _ in _stored(spark, path)] == list("abcde") and len(versions.latest(spark, path)[1]) <= 2
