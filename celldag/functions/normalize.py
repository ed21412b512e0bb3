"""Value normalisers: a closed catalogue of steps, composed by data.

A step maps a struct (num, text, unit) to another.  What a step doesn't recognise passes through
unchanged.
"""

from __future__ import annotations

from collections.abc import Callable

import yaml
from pyspark.sql import Column
from pyspark.sql import functions as F

from celldag.functions.units import Units

PLAIN = r"^\s*[-+]?\d+(\.\d+)?\s*$"


class NormalizeError(ValueError):
    """A step or preset is not well formed."""


def _state(num: Column, text: Column, unit: Column) -> Column:
    return F.struct(num.cast("double").alias("num"), text.cast("string").alias("text"), unit.cast("string").alias("unit"))


def _bound(value: Column, made: Callable[[Column], Column]) -> Column:
    """made(value), with the value named: an expression that is used several times isn't written out several times."""
    return F.transform(F.array(value), made)[0]


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _to_number(s: Column, when: Column, number: Column, unit: Column | None = None) -> Column:
    hit = F.coalesce(when, F.lit(False)) & s["text"].isNotNull()
    none = F.lit(None)
    return _state(F.when(hit, number).otherwise(s["num"]), F.when(hit, none).otherwise(s["text"]), F.when(hit, unit).otherwise(s["unit"]) if unit is not None else s["unit"])


def trim_text(s: Column, params: dict, units: Units) -> Column:
    return _state(s["num"], _strip(F.regexp_replace(s["text"], " ", " ")), s["unit"])


def strip_thousands(s: Column, params: dict, units: Units) -> Column:
    bare = F.regexp_replace(_strip(s["text"]), r"(?<=\d),(?=\d{3}\b)", "")
    return _to_number(_state(s["num"], bare, s["unit"]), bare.rlike(PLAIN), bare.try_cast("double"))


def percent_to_ratio(s: Column, params: dict, units: Units) -> Column:
    pattern = r"^\s*([-+]?\d+([.,]\d+)?)\s*%\s*$"
    number = F.regexp_replace(F.regexp_extract(s["text"], pattern, 1), ",", ".").try_cast("double") / 100.0
    out = _to_number(s, s["text"].rlike(pattern), number)
    return _state(F.when(s["num"].isNotNull(), s["num"] / 100.0).otherwise(out["num"]), out["text"], out["unit"]) if params.get("assume_percent") else out


def split_unit_suffix(s: Column, params: dict, units: Units) -> Column:
    plain = s["text"].rlike(PLAIN)
    pattern = r"^\s*([-+]?\d+(?:\.\d+)?)\s*([^\s\d]{1,8})\s*$"
    unit = units.canonical_column(F.regexp_extract(s["text"], pattern, 2))
    known = s["text"].rlike(pattern) & unit.isin(sorted({u for us in units.dimensions.values() for u in us}))
    number = F.regexp_extract(s["text"], pattern, 1).try_cast("double")
    out = _to_number(s, plain | known, F.when(plain, F.trim(s["text"]).try_cast("double")).otherwise(number), F.when(~plain, unit))
    if params.get("allow_unknown"):
        loose = r"^\s*([-+]?\d+(?:\.\d+)?)\s*(\S{1,8})\s*$"
        out = _bound(out, lambda o: _to_number(o, o["text"].rlike(loose), F.regexp_extract(o["text"], loose, 1).try_cast("double"), F.regexp_extract(o["text"], loose, 2)))
    return out


CATALOG = {f.__name__: f for f in (trim_text, strip_thousands, percent_to_ratio, split_unit_suffix)}


def validate_steps(steps: list) -> None:
    if not isinstance(steps, list) or not steps:
        raise NormalizeError("steps must be a list that isn't empty")
    for step in steps:
        if not isinstance(step, dict) or step.get("op") not in CATALOG:
            raise NormalizeError(f"unknown normaliser: {step!r}")
        if step.get("params") is not None and not isinstance(step["params"], dict):
            raise NormalizeError(f"params must be a mapping: {step!r}")


def _applied(step: dict, units: Units) -> Callable[[Column], Column]:
    return lambda s: CATALOG[step["op"]](s, step.get("params") or {}, units)


def apply_steps(num: Column, text: Column, steps: list[dict], units: Units) -> Column:
    """struct(num, text, unit) after all steps; unit: what was last split off."""
    validate_steps(steps)
    state = _state(num, text, F.lit(None))
    for step in steps:
        state = _bound(state, _applied(step, units))
    return state


def load_presets(text: str) -> dict[str, list[dict]]:
    """Presets by id from YAML: a list `normalizers` of {id, steps}."""
    out: dict[str, list[dict]] = {}
    for entry in (yaml.safe_load(text) or {}).get("normalizers") or []:
        if not entry.get("id") or entry["id"] in out:
            raise NormalizeError(f"a preset needs an id of its own: {entry!r}")
        validate_steps(entry.get("steps"))
        out[entry["id"]] = entry["steps"]
    return out
