"""The operators of a transformation chain, each (LFrame, config, Env) -> LFrame."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from celldag.frame import LINEAGE, LFrame, ln, with_fields
from celldag.functions import normalize
from celldag.functions.cells import is_cell, is_null, kind_of, num_of, parse_number, text_of, to_cell
from celldag.functions.units import Units


class DagError(ValueError):
    """A step is unknown or its config is not well formed."""


@dataclass
class Env:
    """What steps may look up: the unit registry, fields' and nodes' units, column-wise units for tables without lineage.

    warnings: one table (column, from_unit, to_unit, cells) per conversion step; nothing runs until it is asked for.
    """

    units: Units = field(default_factory=Units.parse)
    field_units: dict[str, str] = field(default_factory=dict)
    node_units: dict[str, str] = field(default_factory=dict)
    unit_columns: dict[str, str] = field(default_factory=dict)
    warnings: list[DataFrame] = field(default_factory=list)


def select(fr: LFrame, cfg: dict, env: Env) -> LFrame:
    """Listed columns that exist, in the listed order."""
    keep = tuple(c for c in (cfg.get("columns") or fr.columns) if c in fr.columns)
    drop = [x for c in fr.columns if c not in keep for x in (c, *fr.companions([c]))]
    return fr.with_df(fr.df.drop(*drop), columns=keep, members={k: tuple(c for c in keep if c in v) for k, v in fr.members.items()})


def rename(fr: LFrame, cfg: dict, env: Env) -> LFrame:
    """New names by {old: new}; where two columns get one name, the later one wins."""
    names = {c: (cfg.get("map") or {}).get(c, c) for c in fr.columns}
    winner = {new: old for old, new in names.items()}
    lost = [c for c in fr.columns if winner[names[c]] != c]
    df = fr.df.drop(*[x for c in lost for x in (c, *fr.companions([c]))])
    kept = {c: n for c, n in names.items() if c not in lost}
    df = df.withColumnsRenamed(kept | ({ln(c): ln(n) for c, n in kept.items()} if fr.lineage else {}))
    order = tuple(dict.fromkeys(names.values()))
    return fr.with_df(df, columns=order, members={k: tuple(dict.fromkeys(names[c] for c in v)) for k, v in fr.members.items()})


def type_cast(fr: LFrame, cfg: dict, env: Env) -> LFrame:
    """numeric: the number or null; text: as text; other targets change nothing."""
    change = {}
    for name, target in (cfg.get("types") or {}).items():
        if name not in fr.columns:
            continue
        kind, c = kind_of(fr.df, name), F.col(f"`{name}`")
        if target == "numeric":
            change[name] = num_of(c, kind) if isinstance(kind, T.NumericType) else F.coalesce(num_of(c, kind), parse_number(text_of(c, kind)))
        elif target == "text":
            change[name] = text_of(c, kind)
    return fr.with_df(fr.df.withColumns(change))


def unit_convert(fr: LFrame, cfg: dict, env: Env) -> LFrame:
    """Cells to their columns' target units, each from its own unit: that of its lineage, else its node's, else a unit column's.

    Rounded to 6 places.  Cells without a unit, or spelled as the target already, or derived or
    aggregated, or from a node in skip_nodes stay.  So do those whose unit can't be converted;
    they are counted in env.warnings.
    """
    targets = {c: t for c, t in (cfg.get("targets") or env.field_units).items() if t and c in fr.columns}
    change, warn = {}, []
    nodes = F.create_map(*[F.lit(x) for kv in sorted(env.node_units.items()) for x in kv]) if env.node_units else None
    for name, target in targets.items():
        c, kind = F.col(f"`{name}`"), kind_of(fr.df, name)
        num = num_of(c, kind)
        unit = F.lit(None).cast("string")
        free = F.lit(True)
        if fr.lineage:
            mark = F.col(f"`{ln(name)}`")
            unit = mark["unit"] if nodes is None else F.coalesce(mark["unit"], F.try_element_at(nodes, mark["node_id"]))
            free = mark["derived"].isNull() & mark["aggregated"].isNull() & ~F.coalesce(mark["node_id"].isin(cfg.get("skip_nodes") or []), F.lit(False))
        if name in env.unit_columns:
            unit = F.coalesce(unit, F.col(f"`{env.unit_columns[name]}`"))
        due = free & num.isNotNull() & unit.isNotNull() & (unit != "") & (unit != target)
        new = env.units.convert(num, unit, target)
        done = due & new.isNotNull()
        value = F.struct(F.when(done, new).otherwise(c["num"]).alias("num"), c["text"].alias("text")) if is_cell(kind) else F.when(done, new).otherwise(c)
        change[name] = value
        if fr.lineage:
            change[ln(name)] = F.when(done, mark.withField("unit", F.lit(target))).otherwise(mark)
        warn.append(F.when(due & new.isNull(), F.struct(F.lit(name).alias("column"), unit.alias("from_unit"), F.lit(target).alias("to_unit"))))
    if warn:
        told = fr.df.select(F.explode(F.filter(F.array(*warn), lambda x: x.isNotNull())).alias("w")).select("w.*")
        env.warnings.append(told.groupBy("column", "from_unit", "to_unit").agg(F.count("*").alias("cells")))
    return fr.with_df(fr.df.withColumns(change))


def value_normalize(fr: LFrame, cfg: dict, env: Env) -> LFrame:
    """Catalogue steps by rule {steps, node_ids?, columns?}; a unit split off goes to the lineage for unit_convert.

    Columns that a rule touches become mixed ones (struct of num and text).
    """
    for rule in cfg.get("rules") or []:
        steps, nodes = rule.get("steps") or [], rule.get("node_ids") or []
        normalize.validate_steps(steps)
        change, df = {}, fr.df
        names = [c for c in (rule.get("columns") or fr.columns) if c in fr.columns]
        for i, name in enumerate(names):
            c = to_cell(F.col(f"`{name}`"), kind_of(fr.df, name))
            df = df.withColumn(f"__s_{i}", normalize.apply_steps(c["num"], c["text"], steps, env.units))
        for i, name in enumerate(names):
            c, out = to_cell(F.col(f"`{name}`"), kind_of(fr.df, name)), F.col(f"__s_{i}")
            hit = ~(out["num"].eqNullSafe(c["num"]) & out["text"].eqNullSafe(c["text"]))
            if nodes and fr.lineage:
                hit = hit & F.coalesce(F.col(f"`{ln(name)}`.node_id").isin(nodes), F.lit(False))
            elif nodes:
                hit = F.lit(False)
            change[name] = F.when(hit, F.struct(out["num"].alias("num"), out["text"].alias("text"))).otherwise(c)
            if fr.lineage:
                mark = F.col(f"`{ln(name)}`")
                done = with_fields(mark, unit=F.coalesce(mark["unit"], out["unit"]), normalized=F.array(*[F.lit(s["op"]) for s in steps]))
                change[ln(name)] = F.when(hit & mark.isNotNull(), done).otherwise(mark)
        fr = fr.with_df(df.withColumns(change).drop(*[f"__s_{i}" for i in range(len(names))]))
    return fr


def comparison(c: Column, kind: T.DataType, op: str, value) -> Column:
    """Never null.  Null equals null and differs from any value; other comparisons with null are false."""
    numeric = isinstance(value, (int, float)) and not isinstance(value, bool)
    if op == "contains":
        return F.coalesce(F.contains(text_of(c, kind), F.lit(str(value))), F.lit(False)) if value is not None else F.lit(False)
    if value is None:
        side = F.when(is_null(c, kind), F.lit(None).cast("string")).otherwise("")
        other = F.lit(None).cast("string")
    elif numeric:
        side, other = (num_of(c, kind) if is_cell(kind) or not isinstance(kind, T.NumericType) else c), F.lit(value)
    else:
        side, other = (c["text"] if is_cell(kind) else c if not isinstance(kind, T.NumericType) else F.lit(None).cast("string")), F.lit(value)
    if op == "==":
        return side.eqNullSafe(other)
    if op == "!=":
        return ~side.eqNullSafe(other)
    made = {">": side > other, ">=": side >= other, "<": side < other, "<=": side <= other}
    if op not in made:
        raise DagError(f"unknown comparison: {op!r}")
    return F.coalesce(made[op], F.lit(False))


def _column(fr: LFrame, name: str) -> tuple[Column, T.DataType]:
    """A column, or null where there is none of that name."""
    return (F.col(f"`{name}`"), kind_of(fr.df, name)) if name in fr.columns else (F.lit(None).cast("string"), T.StringType())


def filter_rows(fr: LFrame, cfg: dict, env: Env) -> LFrame:
    """Rows for which column op value holds."""
    if cfg.get("column") is None:
        raise DagError(f"filter needs a column: {cfg}")
    return fr.with_df(fr.df.where(comparison(*_column(fr, cfg["column"]), cfg.get("op", "=="), cfg.get("value"))))


def value_mapping(fr: LFrame, cfg: dict, env: Env) -> LFrame:
    """Values by {from: to}: looked up as they are, as text, and whole numbers without the point; else kept, or `default`.

    Null is looked up as the text None and gets the default too.
    """
    name, mapping, default = cfg.get("column"), cfg.get("map") or {}, cfg.get("default", "__keep__")
    if name not in fr.columns:
        return fr
    c, kind = _column(fr, name)
    num = num_of(c, kind)
    whole = F.when(num == F.floor(num), F.floor(num).cast("string"))
    numbers = {float(k): v for k, v in mapping.items() if isinstance(k, (int, float)) and not isinstance(k, bool)}
    texts = {k: v for k, v in mapping.items() if isinstance(k, str)}
    keep_num = [v for v in [*mapping.values(), *([] if default == "__keep__" else [default])] if not isinstance(v, str) and v is not None]
    mixed = is_cell(kind) or bool(keep_num) != isinstance(kind, T.NumericType) or any(isinstance(v, str) for v in [*mapping.values(), *([] if default == "__keep__" else [default])]) and isinstance(kind, T.NumericType)
    all_text = not keep_num and not is_cell(kind) and not isinstance(kind, T.NumericType)

    def out(v):
        if all_text or (not mixed and isinstance(kind, T.NumericType)):
            return F.lit(v).cast(kind.simpleString())
        return F.struct(F.lit(v if isinstance(v, (int, float)) else None).cast("double").alias("num"), F.lit(v if isinstance(v, str) else None).cast("string").alias("text"))

    as_text = F.coalesce(text_of(c, kind), F.lit("None"))
    cases = [(F.coalesce(num == k, F.lit(False)), v) for k, v in numbers.items()]
    cases += [(as_text == k, v) for k, v in texts.items()]
    cases += [(F.coalesce(whole == k, F.lit(False)), v) for k, v in texts.items()]
    rest = out(default) if default != "__keep__" else (c if all_text or (not mixed and isinstance(kind, T.NumericType)) else to_cell(c, kind))
    value = reduce(lambda acc, case: F.when(case[0], out(case[1])).otherwise(acc), reversed(cases), rest)
    return fr.with_df(fr.df.withColumn(name, value))


def null_handling(fr: LFrame, cfg: dict, env: Env) -> LFrame:
    """drop: rows with a null in any of the columns (an unknown column is null); fill: fill_value for nulls of known columns."""
    names = cfg.get("columns") or list(fr.columns)
    if cfg.get("mode", "drop") == "fill":
        fill, change = cfg.get("fill_value"), {}
        for name in [n for n in names if n in fr.columns]:
            c, kind = _column(fr, name)
            same = isinstance(fill, str) == isinstance(kind, T.StringType) and not is_cell(kind)
            filled = F.lit(fill).cast(kind.simpleString()) if same else F.struct(F.lit(fill if not isinstance(fill, str) else None).cast("double").alias("num"), F.lit(fill if isinstance(fill, str) else None).cast("string").alias("text"))
            change[name] = F.when(is_null(c, kind), filled).otherwise(c if same else to_cell(c, kind))
        return fr.with_df(fr.df.withColumns(change))
    full = reduce(lambda a, b: a & b, [~is_null(*_column(fr, n)) for n in names], F.lit(True))
    return fr.with_df(fr.df.where(full))


def deduplicate(fr: LFrame, cfg: dict, env: Env) -> LFrame:
    """The first row of each frame and key (default: all columns)."""
    keys = [c for c in (cfg.get("keys") or fr.columns) if c in fr.columns]
    first = Window.partitionBy("__frame", *[F.col(f"`{k}`") for k in keys]).orderBy("__src", "__ord")
    return fr.with_df(fr.df.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n"))


def union(fr: LFrame, cfg: dict, env: Env) -> LFrame:
    """All frames as one; columns that a frame lacks are null there.  Order and each row's origin stay."""
    return fr.with_df(fr.df.withColumn("__frame", F.lit(0)), members={0: fr.columns})


def join(fr: LFrame, cfg: dict, env: Env) -> LFrame:
    """Full outer join of all frames that have the `on` columns: one row per key (null equals null), at its first row's place.

    In each other column the last value that isn't null wins, its lineage with it.  One grouping
    does it for any number of frames.  With fewer than two such frames nothing changes.
    """
    on = cfg.get("on") or []
    if not on:
        raise DagError("join needs config.on")
    joinable = [k for k, cols in sorted(fr.members.items()) if all(c in cols for c in on)]
    if len(joinable) < 2 and fr.members:
        return fr
    inside = F.col("__frame").isin(joinable) if fr.members else F.lit(True)
    columns = tuple(dict.fromkeys([*on, *[c for k in joinable for c in fr.members[k]], *([] if fr.members else fr.columns)]))
    at = F.struct("__src", "__ord")
    # The value with its lineage in one struct: both come from one cell.
    pick = lambda c: F.struct(F.col(f"`{c}`").alias("v"), *([F.col(f"`{ln(c)}`").alias("l")] if fr.lineage else []))
    aggs = [F.expr(f"max_by(__p_{i}, __at) FILTER (WHERE NOT __null_{i})").alias(f"__w_{i}") for i, c in enumerate(columns)]
    prepared = fr.df.where(inside).select(
        *[F.col(f"`{c}`").alias(f"__k_{i}") for i, c in enumerate(on)], at.alias("__at"), "__meta",
        *[pick(c).alias(f"__p_{i}") for i, c in enumerate(columns)], *[is_null(F.col(f"`{c}`"), kind_of(fr.df, c)).alias(f"__null_{i}") for i, c in enumerate(columns)],
    )
    grouped = prepared.groupBy(*[f"__k_{i}" for i in range(len(on))]).agg(F.min("__at").alias("__first"), F.expr("min_by(__meta, __at) FILTER (WHERE __meta IS NOT NULL)").alias("__meta"), *aggs)
    out = grouped.select(
        *[F.col(f"__w_{i}.v").alias(c) for i, c in enumerate(columns)], F.lit(joinable[0] if joinable else 0).alias("__frame"), F.col("__first.__src").alias("__src"), F.col("__first.__ord").alias("__ord"), "__meta",
        *([F.col(f"__w_{i}.l").alias(ln(c)) for i, c in enumerate(columns)] if fr.lineage else []),
    )
    members = {k: v for k, v in fr.members.items() if k not in joinable} | {joinable[0] if joinable else 0: columns}
    if len(members) == 1:
        return LFrame(out, columns, members, fr.lineage)
    rest = tuple(dict.fromkeys([*columns, *[c for v in members.values() for c in v]]))
    return LFrame(out.unionByName(fr.df.where(~inside), allowMissingColumns=True), rest, members, fr.lineage)


def aggregate(fr: LFrame, cfg: dict, env: Env) -> LFrame:
    """Per frame: group_by (null is a group), then sum, avg, min or max of the numbers, or count of all rows.

    A column's lineage is the group's first one, marked aggregated.
    """
    keys, aggs = list(cfg.get("group_by") or []), dict(cfg.get("aggs") or {})
    functions = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}
    made, marks = [], []
    at = F.struct("__src", "__ord")
    for name, how in aggs.items():
        if how == "count":
            made.append(F.count(F.lit(1)).alias(name))
        elif how in functions:
            made.append(functions[how](num_of(*_column(fr, name))).alias(name))
        else:
            raise DagError(f"unknown aggregate: {how!r}")
    if fr.lineage:
        for name in [*keys, *aggs]:
            has = ln(name) in fr.df.columns
            first = F.expr(f"min_by(`{ln(name)}`, struct(__src, __ord)) FILTER (WHERE `{ln(name)}` IS NOT NULL)") if has else F.lit(None).cast(LINEAGE)
            marks.append((first if has else F.any_value(first)).alias(ln(name)))
    df = fr.df.groupBy("__frame", *[F.col(f"`{k}`") for k in keys]).agg(*made, F.min(at).alias("__first"), F.expr("min_by(__meta, struct(__src, __ord)) FILTER (WHERE __meta IS NOT NULL)").alias("__meta"), *marks)
    df = df.withColumns({"__src": F.col("__first.__src"), "__ord": F.col("__first.__ord")}).drop("__first")
    if fr.lineage:
        df = df.withColumns({ln(n): F.when(F.col(f"`{ln(n)}`").isNotNull(), F.col(f"`{ln(n)}`").withField("aggregated", F.lit(how))) for n, how in aggs.items()})
    columns = (*keys, *aggs)
    return LFrame(df, columns, {k: columns for k in fr.members}, fr.lineage)


def derived_column(fr: LFrame, cfg: dict, env: Env) -> LFrame:
    """name = left op right, of columns or numbers; null if either isn't a number, or at division by 0."""
    name, expr = cfg.get("name"), cfg.get("expr") or {}
    functions = {"add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "div": F.try_divide}
    if not name or expr.get("op") not in functions:
        raise DagError(f"derived_column is not well formed: {cfg}")
    side = lambda v: F.lit(float(v)) if isinstance(v, (int, float)) else num_of(*_column(fr, v))
    change = {name: functions[expr["op"]](side(expr.get("left")), side(expr.get("right")))}
    if fr.lineage:
        source = expr.get("left") if isinstance(expr.get("left"), str) else expr.get("right")
        mark = F.col(f"`{ln(source)}`") if isinstance(source, str) and source in fr.columns else F.lit(None).cast(LINEAGE)
        change[ln(name)] = F.when(mark.isNotNull(), mark.withField("derived", F.lit(expr["op"])))
    columns = fr.columns if name in fr.columns else (*fr.columns, name)
    return fr.with_df(fr.df.withColumns(change), columns=columns, members={k: v if name in v else (*v, name) for k, v in fr.members.items()})


def validation(fr: LFrame, cfg: dict, env: Env) -> LFrame:
    """Rules {column, op, value}, which null passes.  flag: column _valid, 1 or 0; drop: only valid rows."""
    ok = F.lit(True)
    for rule in cfg.get("rules") or []:
        c, kind = _column(fr, rule.get("column"))
        ok = ok & (is_null(c, kind) | comparison(c, kind, rule.get("op", "=="), rule.get("value")))
    if cfg.get("mode", "flag") == "drop":
        return fr.with_df(fr.df.where(ok))
    change = {"_valid": F.when(ok, 1).otherwise(0)} | ({ln("_valid"): F.lit(None).cast(LINEAGE)} if fr.lineage else {})
    add = lambda v: v if "_valid" in v else (*v, "_valid")
    return fr.with_df(fr.df.withColumns(change), columns=add(fr.columns), members={k: add(v) for k, v in fr.members.items()})


BLOCKS: dict[str, Callable[[LFrame, dict, Env], LFrame]] = {
    "select": select, "rename": rename, "type_cast": type_cast, "unit_convert": unit_convert, "value_normalize": value_normalize, "filter": filter_rows, "value_mapping": value_mapping,
    "null_handling": null_handling, "deduplicate": deduplicate, "union": union, "join": join, "aggregate": aggregate, "derived_column": derived_column, "validation": validation,
}


def run_dag(fr: LFrame, steps: list[dict], env: Env | None = None) -> LFrame:
    """Steps {op, config} one after the other, as one lazy plan."""
    env = env or Env()
    for step in steps:
        if step.get("op") not in BLOCKS:
            raise DagError(f"unknown operator: {step.get('op')!r}")
        fr = BLOCKS[step["op"]](fr, step.get("config") or {}, env)
    return fr
