"""Units: spelling, dimensions and affine conversion, worked out on the driver and applied as columns."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Alternative spellings and conversion factors of units (base = value * factor + offset).
DEFAULT = """
version: "2"
aliases: {"°C": "℃", degC: "℃", "deg C": "℃", celsius: "℃", C: "℃", Kelvin: K, F: "°F", degF: "°F", PCT: "%", percent: "%", "wt%": "%", "mass%": "%", "% (w/w)": "%", "mass percent": "%", Kg: kg, KG: kg, metric ton: t, ton: t, tonne: t, Pa.s: Pa·s, Pa s: Pa·s, Pas: Pa·s, mPa.s: mPa·s, mPa s: mPa·s, pcs: EA, ea: EA, count: EA, "개": EA, mass fraction: fraction, "0~1": fraction, ratio: fraction, RPM: rpm}
dimensions:
  temperature: {"℃": 1.0, K: {factor: 1.0, offset: -273.15}, "°F": {factor: 0.5555555555555556, offset: -17.77777777777778}}
  pressure: {bar: 1.0, kPa: 0.01, MPa: 10.0, Pa: 0.00001, psi: 0.0689475729}
  mass: {kg: 1.0, g: 0.001, mg: 0.000001, t: 1000.0}
  length: {mm: 1.0, cm: 10.0, m: 1000.0, um: 0.001}
  concentration: {"%": 1.0, ppm: 0.0001, fraction: 100.0}
  percent: {"%": 1.0, fraction: 100.0}
  vibration_velocity: {mm/s: 1.0}
  viscosity: {cP: 1.0, mPa·s: 1.0, Pa·s: 1000.0}
  strength: {MPa: 1.0, GPa: 1000.0}
  energy: {kWh: 1.0, MWh: 1000.0, Wh: 0.001}
  rotation_speed: {rpm: 1.0}
  count: {EA: 1.0}
  time_of_day: {}
"""


@dataclass
class Units:
    """A small, closed registry; what it knows is shipped inside expressions."""

    version: str
    aliases: dict[str, str]
    dimensions: dict[str, dict[str, tuple[float, float]]] = field(default_factory=dict)

    @classmethod
    def parse(cls, text: str = DEFAULT) -> Units:
        raw = yaml.safe_load(text) or {}
        pair = lambda e: (float(e.get("factor", 1)), float(e.get("offset", 0))) if isinstance(e, dict) else (float(e), 0.0)
        return cls(str(raw.get("version", "0")), raw.get("aliases") or {}, {d: {u: pair(e) for u, e in (us or {}).items()} for d, us in (raw.get("dimensions") or {}).items()})

    def canonical(self, unit: str | None) -> str | None:
        """Without a condition such as `@25℃`, aliases resolved."""
        if unit is None:
            return None
        unit = re.sub(r"\s*@.*$", "", unit.strip()).strip()
        return self.aliases.get(unit, unit)

    def dimensions_of(self, unit: str | None) -> set[str]:
        return {d for d, us in self.dimensions.items() if self.canonical(unit) in us}

    def affine(self, source: str, target: str) -> tuple[float, float] | None:
        """(a, b) of target = a * source + b in the alphabetically first shared dimension; None if there is none."""
        s, t = self.canonical(source), self.canonical(target)
        if s == t:
            return 1.0, 0.0
        shared = sorted(self.dimensions_of(s) & self.dimensions_of(t))
        if not shared:
            return None
        (fs, os), (ft, ot) = (self.dimensions[shared[0]][u] for u in (s, t))
        return fs / ft, (os - ot) / ft

    def spellings(self) -> list[str]:
        """All spellings that have a dimension."""
        names = {u for us in self.dimensions.values() for u in us}
        return sorted(names | {a for a, u in self.aliases.items() if u in names})

    def pairs(self, targets: list[str]) -> list[tuple[str, str, float, float]]:
        """(from, to, a, b) of every convertible spelling and target."""
        return [(s, t, *ab) for t in dict.fromkeys(targets) for s in self.spellings() if (ab := self.affine(s, t))]

    def pair_table(self, spark: SparkSession, targets: list[str]) -> DataFrame:
        return spark.createDataFrame(self.pairs(targets), "from_unit string, to_unit string, a double, b double")

    def convert(self, value: Column, unit: Column, target: str) -> Column:
        """value * a + b rounded to 6 places, by the row's unit; null where it can't be converted."""
        bare = F.trim(F.regexp_replace(F.trim(unit), r"\s*@.*$", ""))
        factors = F.create_map(*[x for s, _, a, b in self.pairs([target]) for x in (F.lit(s), F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")))])
        ab = F.try_element_at(factors, bare)
        same = bare == F.lit(self.canonical(target))
        return F.when(same, F.round(value, 6)).otherwise(F.round(value * ab["a"] + ab["b"], 6))

    def canonical_column(self, unit: Column) -> Column:
        bare = F.trim(F.regexp_replace(F.trim(unit), r"\s*@.*$", ""))
        return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in sorted(self.aliases.items()) for x in kv]), bare), bare)
