"""What an attribute means: built-in families, and declarations read from rows on ``attr:<name>``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.values import text_of
from ..schema import CONTAINED, CONTAINMENT, DECLARED, LATERAL, SET_VALUED, STRUCTURAL
from .visible import Snapshot, visible

#: Declared attributes that a policy holds at most; they are a vocabulary, not data.
MOST = 100_000


@dataclass(frozen=True)
class Policy:
    """Names of attributes by what is done with them."""

    sets: tuple[str, ...] = SET_VALUED
    containment: tuple[str, ...] = CONTAINMENT
    lateral: tuple[str, ...] = LATERAL
    accrues: tuple[str, ...] = ()
    structural: tuple[str, ...] = STRUCTURAL

    @classmethod
    def declared(cls, s: Snapshot) -> Policy:
        """The built-in names and the log's declarations; of several for one predicate the last row counts."""
        rows = visible(Snapshot(s.log, None, s.asserted_as_of), F.col("entity").startswith("attr:") & F.col("attribute").isin(*DECLARED))
        last = rows.groupBy("entity", "attribute").agg(F.max_by(F.coalesce(text_of(F.col("value")), F.col("value")), "seq").alias("says"))
        said = last.limit(MOST + 1).collect()
        if len(said) > MOST:
            raise ValueError(f"more than {MOST} declarations")
        at: dict[str, dict[str, str]] = {}
        for r in said:
            at.setdefault(r["entity"].removeprefix("attr:"), {})[r["attribute"]] = r["says"]

        def names(start: tuple[str, ...], predicate: str, *values: str) -> tuple[str, ...]:
            yes = {a for a, d in at.items() if d.get(predicate) in values}
            no = {a for a, d in at.items() if predicate in d and d[predicate] not in values}
            return tuple(sorted((set(start) - no) | yes))

        return cls(names(SET_VALUED, "arity", "set"), names(CONTAINMENT, "relation_family", "containment"), names(LATERAL, "relation_family", "lateral"), names((), "fold_policy", "accrue"), names(STRUCTURAL, "structural", "true"))

    def fold_attribute(self) -> Column:
        return F.when(F.col("attribute").isin(*self.containment), CONTAINED).otherwise(F.col("attribute"))

    def is_set(self) -> Column:
        return F.col("attribute").isin(*self.sets)

    def accrual(self) -> Column:
        return F.col("attribute").isin(*self.accrues) if self.accrues else F.lit(False)
