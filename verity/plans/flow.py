"""Typed flows: a DataFrame and the keys of its ancestors."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verity.functions.text import split_text


@dataclass(frozen=True)
class Flow:
    """Rows at the depth of ``keys``: a row's ancestors are its key columns, outermost first. Methods only build plans."""

    df: DataFrame
    keys: tuple[str, ...]

    @property
    def fields(self) -> list[str]:
        return [c for c in self.df.columns if c not in self.keys]

    def apply_rows(self, f: Callable[[DataFrame], DataFrame]) -> Flow:
        """A one-to-one transform, which must keep the keys."""
        return self._kept(f(self.df))

    def pmap(self, f: Callable[[Flow], Flow]) -> Flow:
        """A sub-flow for every row: it may go deeper, but must keep this flow's keys first."""
        out = f(self)
        if out.keys[: len(self.keys)] != self.keys:
            raise ValueError(f"the sub-flow's keys {out.keys} don't begin with {self.keys}")
        return out

    def split_text(self, col: str, level: str, id_col: str) -> Flow:
        """One level deeper: the non-empty pieces of a text column."""
        return Flow(split_text(self.df, col, level, list(self.keys), id_col).drop("last"), (*self.keys, id_col))

    def join(self, other: Flow) -> Flow:
        """Pairs (a, b) at this depth.

        Flows of one depth are joined row by row; a deeper flow is nested, level by level in the order of its ids,
        below the row that is its ancestor. Other levels don't fit, which raises here and not at run time.
        """
        if other.keys[: len(self.keys)] != self.keys:
            raise ValueError(f"{other.keys} isn't at or below {self.keys}")
        a = self.df.select(*self.keys, F.struct(*self.fields).alias("a"))
        if other.keys == self.keys:
            return Flow(a.join(other.df.select(*self.keys, F.struct(*other.fields).alias("b")), list(self.keys)), self.keys)
        nested = other.df.select(*other.keys, F.struct(*other.fields).alias("b"))
        for depth in range(len(other.keys) - 1, len(self.keys) - 1, -1):
            up, own = list(other.keys[:depth]), other.keys[depth]
            nested = nested.groupBy(*up).agg(F.sort_array(F.collect_list(F.struct(own, "b"))).alias("_l"))
            nested = nested.select(*up, F.transform("_l", lambda x: x["b"]).alias("b"))
        return Flow(a.join(nested, list(self.keys), "left"), self.keys)

    def select_side(self, side: int) -> Flow:
        """One side of a join: its fields, or the nested list under ``b``."""
        if side not in (0, 1):
            raise ValueError("side is 0 or 1")
        name = "ab"[side]
        nested = not isinstance(self.df.schema[name].dataType, type(self.df.schema["a"].dataType))
        return Flow(self.df.select(*self.keys, name if nested else f"{name}.*"), self.keys)

    def flatten(self, id_col: str = "child_id") -> Flow:
        """One level less: children are numbered within their grandparent, in the order of the ids."""
        if len(self.keys) < 3:
            raise ValueError("only a stream of streams can be flattened")
        *up, parent, own = self.keys
        order = F.row_number().over(Window.partitionBy(*up).orderBy(parent, own)) - 1
        return Flow(self.df.withColumn("_k", order).drop(parent, own).withColumnRenamed("_k", id_col).select(*up, id_col, *self.fields), (*up, id_col))

    def ordered(self) -> DataFrame:
        """The rows in the order of their ids."""
        return self.df.orderBy(*self.keys)

    def _kept(self, df: DataFrame) -> Flow:
        if missing := set(self.keys) - set(df.columns):
            raise ValueError(f"the transform lost {sorted(missing)}")
        return Flow(df, self.keys)
