"""LFrame: a list of labelled frames with cell lineage, as one DataFrame.

System columns: `__frame` (which frame a row is in), `__src` and `__ord` (the rows' total order:
source frame first), `__meta` (where the row came from) and, with lineage, a companion
`__ln__<column>` per column.  Companions are pruned from plans that don't ask for them.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINEAGE = "struct<payload_id:string,row_idx:bigint,node_id:string,unit:string,version_id:string,cell:string,derived:string,aggregated:string,normalized:array<string>>"
META = "struct<document_id:string,version_id:string,sheet:string,locator:string>"
SYSTEM = ("__frame", "__src", "__ord", "__meta")


def ln(name: str) -> str:
    return f"__ln__{name}"


def with_fields(c: Column, **fields: Column) -> Column:
    for name, value in fields.items():
        c = c.withField(name, value)
    return c


@dataclass(frozen=True)
class LFrame:
    """columns: in order, over all frames; lineage: are there companions?

    members: each frame's own columns, where the frames are few and known.  Frames that come from
    data (one per region of any number of documents) have none listed; all of them count as having all columns.
    """

    df: DataFrame
    columns: tuple[str, ...]
    members: dict[int, tuple[str, ...]]
    lineage: bool = False

    @classmethod
    def of(cls, df: DataFrame, order: Column, frame: int = 0, columns: list[str] | None = None, meta: Column | None = None, lineage: dict[str, Column] | None = None) -> LFrame:
        """One frame from a table.  order: a bigint that tells rows apart; lineage: companions by column."""
        columns = tuple(columns or df.columns)
        extra = [F.lit(frame).alias("__frame"), F.lit(frame).alias("__src"), order.cast("bigint").alias("__ord"), (meta if meta is not None else F.lit(None)).cast(META).alias("__meta")]
        if lineage is not None:
            extra += [lineage.get(c, F.lit(None)).cast(LINEAGE).alias(ln(c)) for c in columns]
        return cls(df.select(*[F.col(f"`{c}`") for c in columns], *extra), columns, {frame: columns}, lineage is not None)

    def together(self, *others: LFrame) -> LFrame:
        """The frames of all, side by side; they keep their numbers, which must differ."""
        out = self
        for o in others:
            if set(out.members) & set(o.members):
                raise ValueError("frames must have numbers of their own")
            columns = out.columns + tuple(c for c in o.columns if c not in out.columns)
            lineage = out.lineage or o.lineage
            df = out.df.unionByName(o.df, allowMissingColumns=True)
            out = LFrame(df, columns, out.members | o.members, lineage)
        return out._complete()

    def _complete(self) -> LFrame:
        missing = [ln(c) for c in self.columns if ln(c) not in self.df.columns] if self.lineage else []
        return self.with_df(self.df.withColumns({c: F.lit(None).cast(LINEAGE) for c in missing}) if missing else self.df)

    def with_df(self, df: DataFrame, **changes) -> LFrame:
        return replace(self, df=df, **changes)

    def companions(self, columns=None) -> list[str]:
        return [ln(c) for c in (self.columns if columns is None else columns)] if self.lineage else []

    def rows(self) -> DataFrame:
        """Only the value columns."""
        return self.df.select(*[F.col(f"`{c}`") for c in self.columns])
