"""A world: one log, its policy, and the verbs over them. Reads are lazy DataFrames; writes are one batch by one writer."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.values import canonical
from .operators import fold as folds
from .operators import gate, identity, knowledge, project, trust, visible, walks
from .operators.semantics import Policy
from .operators.visible import Snapshot
from .schema import CONTAINED, LOG
from .sources import dump as dumps
from .storage import kept


class World:
    def __init__(self, spark: SparkSession, path: str, world_id: str = "world:self") -> None:
        self.spark, self.path, self.world_id = spark, path, world_id
        self._canon: DataFrame | None = None

    @property
    def log(self) -> DataFrame:
        """The log's table; a world that nothing was written to has none."""
        if not dumps.exists(self.spark, self.path):
            return self.spark.createDataFrame([], LOG)
        return self.spark.read.schema(LOG).parquet(self.path)

    def at(self, as_of: float | None = None, asserted_as_of: int | None = None) -> Snapshot:
        return Snapshot(self.log, as_of, asserted_as_of)

    @property
    def canon(self) -> DataFrame:
        if self._canon is None:
            self._canon = identity.canon_map(self.at())
        return self._canon

    @property
    def policy(self) -> Policy:
        return Policy.declared(self.at())

    def folded(self, as_of: float | None = None, asserted_as_of: int | None = None) -> DataFrame:
        return folds.fold(self.at(as_of, asserted_as_of), self.policy, self.canon)

    # Writes

    def _append(self, rows: DataFrame) -> None:
        dumps.numbered(self.log, rows, self.world_id).write.mode("append").parquet(self.path)
        self._canon = None

    def ingest_structured(self, items: Iterable[dict], at: float | None = None, frame: str = "canon", role: str = "ingestor", atomic: bool = False) -> DataFrame:
        """Put items (ITEM fields; value any JSON) through the gate and append what passes; the receipts of what didn't.

        With ``atomic`` a single skipped item keeps all of them out, and raises.
        """
        fields = [f.split() for f in gate.ITEM.split(", ")]
        rows = []
        for n, item in enumerate(items, 1):
            row = [item.get(name) for name, _ in fields]
            row[2] = canonical(item.get("value"))
            rows.append((n, *[float(v) if kind == "double" and v is not None else v for v, (_, kind) in zip(row, fields)]))
        table = self.spark.createDataFrame(rows, "n long, " + gate.ITEM)
        edges = walks.parents(self.folded()).where(F.col("frame") == frame).select("child", "parent")
        passed, skipped = gate.gated(table, edges, self.canon, at, frame, role)
        skipped = kept(skipped, "skipped")
        if atomic and skipped.limit(1).count():
            raise ValueError(f"items were skipped: {skipped.collect()}")
        self._append(kept(gate.with_metas(passed, dumps.head(self.log)), "passed"))
        return skipped

    def _say(self, *rows: tuple) -> None:
        """Append (entity, attribute, value_type, value, frame, status) rows, timeless."""
        full = [(n, e, a, k, canonical(v), None, None, f, s, None) for n, (e, a, k, v, f, s) in enumerate(rows, 1)]
        self._append(self.spark.createDataFrame(full, "n long, entity string, attribute string, value_type string, value string, valid_from double, valid_to double, frame string, status string, confidence double"))

    def retract(self, assertion_id: str, reason: str = "") -> None:
        if not self.log.where(F.col("id") == assertion_id).limit(1).count():
            raise ValueError(f"no such row: {assertion_id}")
        self._say((assertion_id, "retracts", "literal", reason or True, "canon", "stated"))

    def merge(self, a: str, b: str, evidence: str = "") -> str:
        """merged, noop_already_merged or vetoed: containment and declared distinctness stand against it."""
        names = {r["id"]: r["canon"] for r in self.canon.where(F.col("id").isin(a, b)).collect()}
        x, y = sorted((names.get(a, a), names.get(b, b)))
        if x == y:
            return "noop_already_merged"
        if identity.blocks(self.at(), self.canon).where((F.col("a") == x) & (F.col("b") == y)).limit(1).count():
            return "vetoed"
        self._say((a, "same_as", "entity", b, "canon", "stated"), *([(f"a:{dumps.head(self.log) + 1}", "evidence", "literal", evidence, "canon", "stated")] if evidence else []))
        return "merged"

    def maybe_same_as(self, a: str, b: str) -> None:
        """Propose that two are one; confirm() or reject() decides."""
        self._say((a, "maybe_same_as", "entity", b, "canon", "stated"))

    def confirm(self, a: str, b: str, evidence: str = "") -> str:
        """Merge two that were proposed as one; no_proposal where nobody did."""
        names = {r["id"]: r["canon"] for r in self.canon.where(F.col("id").isin(a, b)).collect()}
        x, y = sorted((names.get(a, a), names.get(b, b)))
        if x != y and not identity.proposed(self.at(), self.canon).where((F.col("a") == x) & (F.col("b") == y)).limit(1).count():
            return "no_proposal"
        return self.merge(a, b, evidence)

    def reject(self, a: str, b: str) -> None:
        self._say((a, "distinct_from", "entity", b, "canon", "stated"))

    def correlate(self, a: str, b: str) -> str:
        if identity.edges(self.at(), "distinct_from").where((F.col("a").isin(a, b)) & F.col("b").isin(a, b)).limit(1).count():
            return "vetoed_distinct"
        if identity.edges(self.at(), "aka").where((F.col("a").isin(a, b)) & F.col("b").isin(a, b)).limit(1).count():
            return "noop_already_correlated"
        self._say((a, "aka", "entity", b, "canon", "stated"))
        return "correlated"

    # Reads

    def axis_heads(self) -> DataFrame:
        return visible.axis_heads(self.log)

    def state(self, entity: str, attribute: str, frame: str = "canon", as_of: float | None = None) -> DataFrame:
        shown = CONTAINED if attribute in self.policy.containment else attribute
        names = self.canon.where(F.col("id") == entity).select("canon").first()
        return self.folded(as_of).where((F.col("entity") == (names[0] if names else entity)) & (F.col("attribute") == shown) & (F.col("frame") == frame))

    def state_union(self, entity: str, attribute: str, frame: str = "canon", as_of: float | None = None) -> DataFrame:
        """state() over all facets that aka joins with the entity at the time."""
        s = self.at(as_of)
        facets = identity.facet_map(s)
        shown = CONTAINED if attribute in self.policy.containment else attribute
        names = facets.where(F.col("id") == entity).select("canon").first()
        return folds.fold(s, self.policy, facets).where((F.col("entity") == (names[0] if names else entity)) & (F.col("attribute") == shown) & (F.col("frame") == frame))

    def charter(self, as_of: float | None = None) -> DataFrame:
        """(attribute, value): what the world says of itself."""
        return self.folded(as_of).where((F.col("entity") == self.world_id) & (F.col("frame") == "canon")).select("attribute", F.col("winner_value").alias("value")).orderBy("attribute")

    def open_conflicts(self, as_of: float | None = None) -> DataFrame:
        """(entity, attribute, frame, kind) of every key whose rows contradict one another."""
        return folds.conflicts(self.folded(as_of)).orderBy("entity", "attribute", "frame")

    def snapshot(self, scope: list[str], frame: str = "canon", as_of: float | None = None) -> DataFrame:
        folded = kept(self.folded(as_of), "fold")
        roots = self.spark.createDataFrame([(e,) for e in scope], "entity string")
        return project.with_defaults(project.current(folded, project.scope(folded, roots, frame), frame))

    def where(self, attribute: str, op: str, value: float, frame: str = "canon", as_of: float | None = None) -> DataFrame:
        return walks.where(self.folded(as_of), attribute, op, value, frame).orderBy("entity")

    def aggregate(self, attribute: str, frame: str = "canon", as_of: float | None = None, recursive: bool = False) -> DataFrame:
        return walks.aggregate(kept(self.folded(as_of), "fold"), attribute, frame, recursive)

    def entities(self, frame: str, prefix: str | None = None, as_of: float | None = None) -> DataFrame:
        return knowledge.entities(self.at(as_of), self.canon, frame, prefix).orderBy("entity")

    def facts(self, frame: str, entity: str | None = None, attribute: str | None = None, as_of: float | None = None) -> DataFrame:
        return visible.facts(self.at(as_of), frame, entity, attribute)

    def locate(self, as_of: float | None = None) -> DataFrame:
        return walks.locate(kept(self.folded(as_of), "fold"))

    def contents(self, as_of: float | None = None) -> DataFrame:
        return walks.contents(self.folded(as_of))

    def composition(self, frame: str = "canon", as_of: float | None = None) -> DataFrame:
        return walks.composition(kept(self.folded(as_of), "fold"), frame)

    def features(self, frame: str = "canon", as_of: float | None = None) -> DataFrame:
        return walks.features(self.folded(as_of), frame)

    def path(self, a: str, b: str, as_of: float | None = None) -> DataFrame:
        return walks.shortest(walks.lateral_edges(self.at(as_of)), self.spark.createDataFrame([(a, b)], "a string, b string"))

    def route(self, a: str, b: str, frame: str = "canon", as_of: float | None = None) -> DataFrame:
        return walks.route(self.at(as_of), kept(self.folded(as_of), "fold"), self.spark.createDataFrame([(a, b)], "a string, b string"), frame)

    def events(self, kind: str | None = None, participants: tuple[str, ...] = (), since: float | None = None, until: float | None = None, frame: str = "canon") -> DataFrame:
        return knowledge.events(self.at(until), self.canon, frame, since, kind, participants).orderBy("t", "event")

    def in_transit(self, as_of: float | None = None, frame: str = "canon") -> DataFrame:
        return knowledge.in_transit(self.at(as_of), self.folded(as_of), self.canon, frame)

    def who_knows(self, entity: str, attribute: str, value: object = None, as_of: float | None = None) -> DataFrame:
        return knowledge.who_knows(self.folded(as_of), entity, attribute, None if value is None else canonical(value)).select("frame").orderBy("frame")

    def frame_diff(self, a: str, *b: str, as_of: float | None = None) -> DataFrame:
        return knowledge.frame_diff(kept(self.folded(as_of), "fold"), self.canon, a, *b)

    def confidence(self, as_of: float | None = None, now: float | None = None) -> DataFrame:
        return trust.confidence(self.at(as_of), self.policy, self.canon, kept(self.folded(as_of), "fold"), now)

    def salience(self, frame: str = "canon", as_of: float | None = None) -> DataFrame:
        return trust.salience(self.at(as_of), self.policy, self.canon, frame)

    def neighborhood(self, entity: str, depth: int = 1, max_fanout: int = 64, frame: str = "canon", as_of: float | None = None) -> DataFrame:
        start = self.spark.createDataFrame([(entity,)], "entity string")
        return walks.neighborhood(self.at(as_of), kept(self.folded(as_of), "fold"), start, self.salience(frame, as_of), depth, max_fanout, frame)

    def correlations(self, frame: str = "canon", as_of: float | None = None) -> DataFrame:
        return identity.correlations(self.at(as_of), frame, self.canon)

    def correlation_conflicts(self, frame: str = "canon", as_of: float | None = None) -> DataFrame:
        return identity.correlation_conflicts(self.at(as_of), frame)

    def proposals(self, frame: str = "canon") -> DataFrame:
        return identity.merge_candidates(self.at(), self.canon, frame)

    def extract(self, texts: DataFrame, model: Callable[[str, dict], list[dict]], column: str = "text") -> DataFrame:
        """Items (as JSON) that ``model`` (prompt, schema) finds in each text; asked where the texts are, written nowhere."""
        schema = {"fields": [f.split()[0] for f in gate.ITEM.split(", ")]}

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                found = [(t, json.dumps(i, sort_keys=True)) for t in batch.column(0).to_pylist() if t for i in model(t, schema)]
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.string()) for k in (0, 1)], names=["text", "item"])

        return texts.select(F.col(column).alias("text")).mapInArrow(run, "text string, item string")
