"""The index over report files of differing layout."""

import json

import pytest

from barloom.operators import reports as R


def put(folder, name, body):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(body if isinstance(body, str) else json.dumps(body), encoding="utf-8")


def test_index_of_reports(spark, tmp_path):
    ic = {"rank_ic": {"5": {"mean": 0.1, "ir": 1}, "20": {"mean": 0.2}}, "top_ic": {"5": {"mean": "n/a", "ir": 2.5}}}
    listed = [{"P5": 1, "P50": 2.0}, {"P5": 3, "P50": None}, {"P5": 5, "P50": 4.0}]
    put(tmp_path / "A", "report_2021-01-01.json", {"meta": {"factor_name": "A", "analysis_date": "2021-01-01", "factor_type": "x"}, "layer2_predictive": ic,
        "panel_summary": {"n_symbols": 7, "coverage_mean": 0.5}, "layer3_grouping": {"5": {"longshort": {"sharpe": 1.5}}}, "layer1_quality": {"daily_percentiles": listed}})
    put(tmp_path / "A", "report_2020-01-01.json", {"meta": {"factor_name": "A", "analysis_date": "2020-01-01", "factor_type": "old"}})
    # No name and no date: the folder names the factor, the file's name decides.
    keyed = {"2020-01-02": {"p10": 1.0, "p90": 9.0}, "2020-01-03": {"p10": 2.0}}
    put(tmp_path / "因子 B", "report_1.json", {"panel_summary": {"n_symbols": 1}})
    put(tmp_path / "因子 B", "report_2.json", {"panel_summary": {"n_symbols": 2, "extra": [1, {"a": None}]}, "layer1_quality": {"daily_percentiles": keyed}})
    put(tmp_path / "C", "report_1.json", '{"meta": {"factor_name": "C"')
    put(tmp_path / "D", "report_1.json", "[1, 2]")
    put(tmp_path / "E", "report_1.json", {"layer1_quality": {"daily_percentiles": []}})
    put(tmp_path / "F", "report_1.json", "")
    rows = {r.factor_name: r for r in R.report_index(R.read_report_documents(spark, str(tmp_path)), (5, 20)).collect()}
    assert set(rows) == {"A", "因子 B", "E"}
    a, b = rows["A"], rows["因子 B"]
    assert (a.factor_type, a.analysis_date, a.n_symbols, a.coverage_mean, a.longshort_sharpe_5d) == ("x", "2021-01-01", 7, 0.5, 1.5)
    assert (a.ic_rank_5_mean, a.ic_rank_5_ir, a.ic_rank_20_mean, a.ic_rank_20_ir) == (0.1, 1.0, 0.2, None)
    assert (a.top_ic_5_mean, a.top_ic_5_ir, a.ic_pearson_5_mean) == (None, 2.5, None)
    assert (a.p5, a.p50, a.p10) == (pytest.approx(3), pytest.approx(3), None)
    assert (b.n_symbols, b.p10, b.p90, b.p50) == (2, 1.5, 9.0, None)
    assert rows["E"].p50 is None and rows["E"].n_symbols is None


def test_no_reports(spark, tmp_path):
    put(tmp_path / "x", "report_1.json", "nothing")
    assert R.report_index(R.read_report_documents(spark, str(tmp_path))).count() == 0
