import math
import struct

import duckdb
from pyspark.sql import functions as F

import __spark_entry__
from tremorlake.functions import names, scalars


def one(spark, column, **values):
    fields = [F.lit(v).alias(k) for k, v in values.items()]
    return spark.range(1).select(*fields).select(column.alias("x")).first()["x"]


def test_paths_are_parsed_in_order(spark):
    paths = {
        "d/ab-1__20260503-left-3__20260504.npz": ("ab-1__20260503-left-3__20260504", "ab-1", "left", "ab-1-left", "20260503", True),
        "d/ab-1__x-LeftHand__20260504.npz": ("ab-1__x-LeftHand__20260504", "ab-1", "left", "ab-1-left", "20260504", True),
        "d/a__b-xyz__t.npz": ("a__b-xyz__t", None, None, "a__b-xyz__t", "", False),
        "d/__20260503-left__t.npz": ("__20260503-left__t", None, None, "__20260503-left__t", "20260503", False),
        "r/ab-1/20260423-Right-2/t.npz": ("ab-1__20260423-Right-2__t", "ab-1", "right", "ab-1-right", "20260423", True),
        "p/fgw0917_0502_left/20260502.npz": ("fgw-0917__fgw0917_0502_left__20260502", "fgw-0917", "left", "fgw-0917-left", "20260502", True),
        "p/zyb0201_20260514/t.npz": ("zyb-0201__zyb0201_20260514__t", "zyb-0201", None, "zyb-0201", "20260514", True),
        "t.npz": ("t", None, None, "t", "", False),
    }
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    got = {r["path"]: tuple(r["n"]) for r in df.select("path", names.parse_path(F.col("path")).alias("n")).collect()}
    assert got == paths


def test_name_expressions(spark):
    assert one(spark, names.normalise_subject(F.lit("FGW-0917 "))) == "fgw0917" and one(spark, names.normalise_subject(F.lit(None).cast("string"))) == ""
    assert one(spark, names.session_token(F.lit("a__20260503-left-3__t"))) == "20260503-left-3" and one(spark, names.session_token(F.lit("a__b"))) == ""
    key = names.clip_key(F.lit("a__c1"), F.lit(7))
    assert one(spark, key) == "a__c1__c0007" and tuple(one(spark, names.clip_key_parts(key))) == ("a__c1", 7)
    assert one(spark, names.folder_key(F.lit("/x/y z/b/f.npz"))) == "y_z__b" and one(spark, names.folder_of(F.lit("/x/y/f"))) == "/x/y"
    assert one(spark, names.side_of(F.lit(None).cast("string"), F.lit("left and right"))) == "right"
    assert one(spark, names.rec_key(F.lit("f"), F.lit("left"))) != one(spark, names.rec_key(F.lit("f"), F.lit("right")))
    assert one(spark, names.first_date(F.lit("x"), F.lit("a20260101b20270101"))) == "20260101"


def test_driver_names():
    assert names.scope_tag({}) == "all" and names.scope_tag({"subjects": ["a", "b/c"], "hand": "left"}) == "a_b-c_left" and len(names.scope_tag({"subjects": ["x" * 90]})) == 48
    assert names.split_list(" a, ,b ") == ["a", "b"] and names.split_list(None) == []
    assert names.segmentation_version({"enter_thresh": 1}) != names.segmentation_version({"enter_thresh": 2})
    assert names.run_id({}, "x").count("__") == 2


def test_scalars(spark):
    assert [one(spark, scalars.lag_bucket(F.lit(x))) for x in (float("nan"), -0.1, 0.0, 0.4, 0.41)] == ["nan", "early", "ok", "ok", "late"]
    assert one(spark, scalars.overlap(F.lit(0), F.lit(5), F.lit(5), F.lit(9))) == 0 and one(spark, scalars.hull_iou(F.lit(0), F.lit(4), F.lit(2), F.lit(8))) == 0.25
    assert one(spark, scalars.finite(F.lit(float("inf")))) is None and one(spark, scalars.finite(F.lit(float("nan")))) is None
    assert one(spark, scalars.all_finite(F.array(F.lit(1.0), F.lit(float("nan"))))) is False
    assert one(spark, scalars.to_radians(F.lit(180.0), F.lit(180.0))) == math.pi and one(spark, scalars.to_radians(F.lit(3.0), F.lit(3.0))) == 3.0
    assert one(spark, scalars.zscore(F.lit(5.0), F.lit(2.0), F.lit(0.0))) == 3.0
    frames = F.array(*[F.array(F.lit(float(x)), F.lit(1.0)) for x in (1, 3, 6)])
    assert one(spark, scalars.trajectory(frames, "velocity")) == [[2.0, 0.0], [3.0, 0.0]] and one(spark, scalars.trajectory(frames, "centered"))[2] == [5.0, 0.0]
    cube = one(spark, scalars.cube_limits(F.array(F.lit(0.0), F.lit(2.0)), F.array(F.lit(1.0)), F.array(F.lit(0.0)), 0.0))
    assert [tuple(x) for x in cube] == [(0.0, 2.0), (0.0, 2.0), (-1.0, 1.0)]
    assert one(spark, scalars.centred(F.array(F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)), F.array(F.lit(3.0), F.lit(2.0), F.lit(1.0))), [0, 1]))[0] == [-1.0, 0.0, 1.0]
    assert one(spark, scalars.clean_label(F.lit(" a "), F.lit(False))) == "a" and one(spark, scalars.clean_label(F.lit("a"), F.lit(True))) == ""


def test_rounding_is_that_of_the_sql(spark):
    """Bits and all: by the scaled double, halves away from zero, with the sign of what rounds to zero."""
    odd = [0.0, -0.0, -2e-7, 2e-7, 5e-7, -5e-7, 0.49999999999999994e-6, 1.0000005, 78.8915625, 1e300, 1e303, 9007199254.740993, float("inf"), float("-inf"), float("nan"), None]
    values = odd + [(2 * k + 1) / 2e6 for k in range(-30000, 30000, 7)]
    want = duckdb.execute("SELECT list_transform($1::DOUBLE[], lambda x: round(x, 6))", [values]).fetchall()[0][0]
    df = spark.createDataFrame([(values,)], "v array<double>")
    got = df.select(F.transform("v", lambda x: scalars.rounded(x, 6)).alias("v")).first()["v"]
    flat = [r["v"] for r in df.select(F.explode("v").alias("v")).select(scalars.rounded(F.col("v"), 6).alias("v")).collect()]
    bits = lambda rows: [x if x is None else struct.pack(">d", x) for x in rows]
    assert bits(got) == bits(want) == bits(flat)


def test_trajectories_equal_their_sql_where_steps_round_to_nothing(spark, tmp_path):
    a = [0.1 * k for k in range(64)]
    b = [a[k % 16] + (k // 16) * (-1.0) ** k * 1e-7 for k in range(64)]  # frames that differ from the first by less than rounding shows
    spark.createDataFrame([(1, a), (2, b)], "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = {tuple(x[:2]): x[2:] for x in con.execute(f"SELECT key, frame, centred, velocity FROM ({__spark_entry__.oracle_sql()['trajectories']})").fetchall()}
    got = {(x["key"], x["frame"]): (x["centred"], x["velocity"]) for x in __spark_entry__.queries()["trajectories"](spark, str(tmp_path)).collect()}
    assert "-0.0" in str(want[2, 1]) and str(got) == str({k: want[k] for k in got}) and len(got) == len(want) == 8
