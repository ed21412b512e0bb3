"""The transformation operators on small frames, among them nulls, ties, mixed values and several frames."""

import random

import pytest
from pyspark.sql import functions as F

from celldag.frame import LINEAGE, LFrame
from celldag.operators.dag import DagError, Env, run_dag
from tests import model

SCHEMA = "o long, k string, v double"


def frame(spark, rows, number=0, schema=SCHEMA, lineage=None):
    df = spark.createDataFrame(rows, schema)
    return LFrame.of(df, F.col("o"), frame=number, columns=[c for c in df.columns if c != "o"], lineage=lineage)


def values(fr):
    return [tuple(r) for r in fr.df.orderBy("__frame", "__src", "__ord").select(*fr.columns).collect()]


def step(name, /, **config):
    return {"op": name, "config": config}


def source(unit):
    return F.expr(f"named_struct('payload_id', 'p', 'row_idx', o, 'node_id', 'n1', 'unit', {unit}, 'version_id', 'v', 'cell', 'A1', 'derived', cast(null as string), 'aggregated', cast(null as string), 'normalized', cast(null as array<string>))").cast(LINEAGE)


def test_filter_and_null_handling(spark):
    fr = frame(spark, [(1, "x", 1.0), (2, "y", 2.0), (3, "x", None)])
    assert values(run_dag(fr, [step("filter", column="v", op=">", value=1)])) == [("y", 2.0)]
    assert values(run_dag(fr, [step("filter", column="v", op="!=", value=2)])) == [("x", 1.0), ("x", None)]
    assert values(run_dag(fr, [step("filter", column="v", op="==", value=None)])) == [("x", None)]
    assert values(run_dag(fr, [step("null_handling", columns=["v"])])) == [("x", 1.0), ("y", 2.0)]
    assert values(run_dag(fr, [step("null_handling", columns=["v"], mode="fill", fill_value=9)]))[2] == ("x", 9.0)
    assert values(run_dag(fr, [step("null_handling", columns=["no_such"])])) == []


def test_rename_collision_and_select_order(spark):
    fr = frame(spark, [(1, "x", 1.0)])
    assert run_dag(fr, [step("select", columns=["v", "none", "k"])]).columns == ("v", "k")
    both = run_dag(fr, [step("rename", map={"k": "v"})])
    assert both.columns == ("v",) and values(both) == [(1.0,)]


def test_value_mapping_forms(spark):
    fr = frame(spark, [(1, "O", 180.0), (2, None, 181.0), (3, "P", None)])
    kept = run_dag(fr, [step("value_mapping", column="k", map={"O": "open"})])
    assert [r[0] for r in values(kept)] == ["open", None, "P"]
    other = run_dag(fr, [step("value_mapping", column="k", map={"O": "open"}, default="other")])
    assert [r[0] for r in values(other)] == ["open", "other", "other"]
    named = run_dag(fr, [step("value_mapping", column="v", map={"180": "mid"})]).df.orderBy("__ord").select("v.text", "v.num").collect()
    assert [tuple(r) for r in named] == [("mid", None), (None, 181.0), (None, None)]


def test_derived_division_and_text(spark):
    fr = frame(spark, [(1, "x", 1.0), (2, "y", 0.0), (3, "z", None)])
    made = run_dag(fr, [step("derived_column", name="q", expr={"op": "div", "left": 6, "right": "v"}), step("derived_column", name="t", expr={"op": "add", "left": "k", "right": 1})])
    assert [r[2:] for r in values(made)] == [(6.0, None), (None, None), (None, None)]


def test_validation_passes_nulls(spark):
    fr = frame(spark, [(1, "x", 1.0), (2, "y", 5.0), (3, "z", None)])
    rules = [{"column": "v", "op": "<", "value": 2}]
    assert [r[2] for r in values(run_dag(fr, [step("validation", rules=rules)]))] == [1, 0, 1]
    assert len(values(run_dag(fr, [step("validation", rules=rules, mode="drop")]))) == 2


def test_unit_convert_once_with_lineage_and_warnings(spark):
    fr = frame(spark, [(1, "a", 77.7), (2, "b", 25.0), (3, "c", 5.0), (4, "d", None)], lineage={"v": source("case o when 1 then '°F' when 2 then '℃' when 3 then 'KRW' else 'K' end")})
    env = Env()
    convert = step("unit_convert", targets={"v": "℃"})
    done = run_dag(fr, [convert, convert], env)
    assert [r[1] for r in values(done)] == [round((77.7 - 32) * 5 / 9, 6), 25.0, 5.0, None]
    assert [tuple(r) for r in env.warnings[0].collect()] == [("v", "KRW", "℃", 1)]
    assert done.df.where("k = 'a'").select("__ln__v.unit").first()[0] == "℃"
    skipped = run_dag(fr, [step("unit_convert", targets={"v": "℃"}, skip_nodes=["n1"])])
    assert values(skipped)[0] == ("a", 77.7)


def test_value_normalize_hands_unit_on(spark):
    df = spark.createDataFrame([(1, "  195  "), (2, "1,234.5"), (3, "12%"), (4, "195 ℃"), (5, "3 zorks"), (6, None), (7, "판정: 우수")], "o long, k string")
    fr = LFrame.of(df, F.col("o"), columns=["k"], lineage={"k": source("cast(null as string)")})
    steps = [{"op": s} for s in ("trim_text", "strip_thousands", "percent_to_ratio", "split_unit_suffix")]
    out = run_dag(fr, [step("value_normalize", rules=[{"steps": steps}])]).df.orderBy("__ord")
    got = [(r["num"], r["text"], r["unit"]) for r in out.select("k.num", "k.text", "__ln__k.unit").collect()]
    assert got == [(195.0, None, None), (1234.5, None, None), (0.12, None, None), (195.0, None, "℃"), (None, "3 zorks", None), (None, None, None), (None, "판정: 우수", None)]
    with pytest.raises(ValueError):
        run_dag(fr, [step("value_normalize", rules=[{"steps": [{"op": "no_such"}]}])])


def test_join_takes_value_and_lineage_from_one_cell(spark):
    a = frame(spark, [(1, "x", 1.0), (2, None, 2.0)], lineage={"v": source("'a'")})
    b = frame(spark, [(1, "x", None), (2, None, 5.0), (3, "z", 7.0)], 1, lineage={"v": source("'b'")})
    out = run_dag(a.together(b), [step("join", on=["k"])])
    assert values(out) == [("x", 1.0), (None, 5.0), ("z", 7.0)]
    assert [r[0] for r in out.df.orderBy("__src", "__ord").select("__ln__v.unit").collect()] == ["a", "b", "b"]
    alone = run_dag(a, [step("join", on=["k"])])
    assert len(values(alone)) == 2
    with pytest.raises(DagError):
        run_dag(a, [step("join")])


def test_aggregate_is_per_frame_until_union(spark):
    a, b = frame(spark, [(1, "x", 1.0), (2, None, None)]), frame(spark, [(1, "x", 4.0)], 1)
    both = a.together(b)
    count = step("aggregate", group_by=["k"], aggs={"v": "count"})
    assert sorted(values(run_dag(both, [count])), key=str) == [("x", 1), ("x", 1), (None, 1)] or len(values(run_dag(both, [count]))) == 3
    assert len(values(run_dag(both, [step("union"), count]))) == 2
    assert dict(values(run_dag(both, [step("union"), step("aggregate", group_by=["k"], aggs={"v": "sum"})]))) == {"x": 5.0, None: None}
    with pytest.raises(DagError):
        run_dag(a, [step("aggregate", aggs={"v": "median"})])


def test_unknown_operator(spark):
    with pytest.raises(DagError):
        run_dag(frame(spark, [(1, "x", 1.0)]), [step("explode")])


@pytest.mark.parametrize("seed", range(3))
def test_random_frames_against_plain_rows(spark, seed):
    rng = random.Random(seed)
    make = lambda: [{"k": rng.choice(["a", "b", None]), "v": rng.choice([None, 0.0, 1.0, 2.0, 3.0])} for _ in range(rng.randint(0, 12))]
    frames = [make() for _ in range(3)]
    built = [frame(spark, [(i, r["k"], r["v"]) for i, r in enumerate(f)], n) for n, f in enumerate(frames)]
    fr = built[0].together(*built[1:])
    plain = lambda rows: [(r["k"], r["v"]) for r in rows]
    got = values(run_dag(fr, [step("filter", column="v", op="!=", value=1)]))
    assert got == plain([r for f in model.filter_rows(frames, "v", "!=", 1) for r in f])
    got = values(run_dag(fr, [step("deduplicate", keys=["k"])]))
    assert got == plain([r for f in model.deduplicate(frames, ["k"]) for r in f])
    assert values(run_dag(fr, [step("join", on=["k"])])) == plain(model.join(frames, ["k"]))
    for how in ("count", "sum", "min", "max"):
        got = values(run_dag(fr, [step("aggregate", group_by=["k"], aggs={"v": how})]))
        assert sorted(got, key=str) == sorted(plain(model.aggregate(frames, ["k"], "v", how)), key=str)
