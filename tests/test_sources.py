import pytest
from helpers import rows

from loomline.plans.report import profile
from loomline.sources import tables as S
from loomline.sources.schemas import SCHEMAS, schema_of


def test_csv_columns_by_name_and_nan(spark, tmp_path):
    path = tmp_path / "bureau_balance.csv"
    path.write_text("STATUS,EXTRA,SK_ID_BUREAU,MONTHS_BALANCE\nC,zzz,7,-1\n,zzz,8,\n")
    df = S.scan_csv(spark, str(path), schema_of("bureau_balance"))
    assert rows(df) == [(7, -1, "C"), (8, None, None)]
    with pytest.raises(ValueError):
        S.scan_csv(spark, str(path), schema_of("bureau"))
    pos = tmp_path / "pos.csv"
    names = [c for g in SCHEMAS["pos_cash_balance"].values() for c in g.split()]
    pos.write_text(",".join(names) + "\n1,2,-3,0,0,NaN,4.0,Active\n")
    assert rows(S.scan_csv(spark, str(pos), schema_of("pos_cash_balance")))[0][5] is None


def test_materialise_writes_once(spark, frame, tmp_path):
    path = str(tmp_path / "t")
    assert rows(S.materialise(frame([(1,)], "x int"), path)) == [(1,)]
    assert rows(S.materialise(frame([(2,)], "x int"), path)) == [(1,)]


def test_rows_for_key_is_pushed_down(spark, frame, tmp_path):
    path = str(tmp_path / "t")
    frame([(1, "a"), (2, "b"), (2, "c")], "id bigint, v string").write.parquet(path)
    df = S.rows_for_key(spark, path, "id", 2)
    assert rows(df) == [(2, "b"), (2, "c")]
    assert "EqualTo(id,2)" in df._jdf.queryExecution().executedPlan().toString()


def test_overview(frame):
    assert rows(S.overview(frame([(1, 2), (3, 4)], "a int, b int"))) == [(2, 2, "a,b")]
    assert S.first_rows(frame([(i,) for i in range(9)], "a int")).count() == 5


def test_checkpoint_is_reliable(frame):
    out = S.cut_lineage(frame([(1,), (2,)], "x int"))
    assert rows(out) == [(1,), (2,)] and "Scan ExistingRDD" in out._jdf.queryExecution().executedPlan().toString()


def test_profile_report(frame):
    df = frame([("a", 1, 0, 2.0, "x,y"), ("b", 0, 1, 3.0, "x"), ("b", 1, 1, 4.0, None)], "c string, y int, f int, m double, t string")
    report = profile(df, "y", {"categories": ["c"], "flags": ["f"], "measures": ["m"], "tokens": ["t"]})
    assert {"overview", "null_counts", "class_balance", "default_profile:c", "flag_share", "describe", "box_summary:m"} <= set(report)
    assert rows(report["token_counts:t"]) == [("x", 2), ("y", 1)]
    assert all(part.count() >= 1 for part in report.values())
