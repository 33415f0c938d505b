"""Compact lines ``entity|attribute|value|flags`` as items, orphans and rejects, parsed where the lines are."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import canonical
from ..schema import ENTITY_ID

ITEM = "line string, outcome string, reason string, entity string, attribute string, value_type string, value string, valid_from double, valid_to double, frame string, status string, timeless boolean, correction boolean, source string, caused_by string"
_ID = re.compile(ENTITY_ID)
_STATUS = {"s": "stated", "o": "observed", "i": "inferred", "a": "assumed"}


def scalar(text: str) -> object:
    """A number, true or false, else the text."""
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return {"true": True, "false": False}.get(text, text)


def parsed(line: str) -> dict:
    """One line; outcome is item, orphan (an id without its namespace) or reject, with the reason."""
    out: dict = {"line": line, "outcome": "reject", "timeless": False, "correction": False, "frame": "canon", "status": "stated"}
    parts = line.strip().split("|", 2)
    if len(parts) < 3:
        return out | {"reason": "fields"}
    rest = parts[2]
    try:  # a value in JSON may hold bars
        if rest[:1] in "{[\"" or rest[:2] in ("?{", "?["):
            begin = rest.startswith("?")
            value, end = json.JSONDecoder().raw_decode(rest, int(begin))
            kind, flags = "unresolved" if begin else "literal", rest[end:].removeprefix("|")
        else:
            text, _, flags = rest.partition("|")
            kind, value = ("entity", text[1:]) if text.startswith("@") else ("literal", scalar(text))
    except ValueError:
        return out | {"reason": "value"}
    out |= {"entity": parts[0].strip(), "attribute": parts[1].strip().lower().replace(" ", "_"), "value_type": kind, "value": canonical(value)}
    names = {"vf": "valid_from", "vt": "valid_to", "f": "frame", "s": "status", "doc": "source", "src": "source", "cb": "caused_by"}
    for flag in filter(None, (f.strip() for f in flags.split(","))):
        name, eq, text = flag.partition("=")
        if not eq and name in ("t", "corr"):
            out["timeless" if name == "t" else "correction"] = True
        elif eq and name in names:
            try:
                out[names[name]] = float(text) if name in ("vf", "vt") else _STATUS.get(text, text) if name == "s" else text
            except ValueError:
                return out | {"reason": "flag"}
        else:
            return out | {"reason": "flag"}
    if not out["attribute"]:
        return out | {"reason": "fields"}
    whole = _ID.match(out["entity"]) and (kind != "entity" or _ID.match(str(value)))
    return out | {"outcome": "item" if whole else "orphan"}


def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Every line that isn't blank or a comment, as ITEM."""
    names = [x.split()[0] for x in ITEM.split(", ")]
    kinds = {"string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}
    types = [kinds[x.split()[1]] for x in ITEM.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [parsed(x) for x in batch.column(0).to_pylist() if x and x.strip() and not x.lstrip().startswith("#")]
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in zip(names, types)], names=names)

    return lines.select(column).mapInArrow(run, ITEM)


def completed(parsed_lines: DataFrame, registry: DataFrame) -> DataFrame:
    """Orphan subjects given the one registered id (id) that ends in their name; those with none or several stay orphans."""
    known = registry.select(F.regexp_replace("id", "^[a-z][a-z0-9_]*:", "").alias("entity"), "id").groupBy("entity").agg(F.min("id").alias("full"), F.count_distinct("id").alias("n")).where("n = 1")
    out = parsed_lines.join(known, "entity", "left")
    found = (F.col("outcome") == "orphan") & F.col("full").isNotNull()
    rest = [c for c in parsed_lines.columns if c not in ("entity", "outcome")]
    return out.select(F.when(found, F.col("full")).otherwise(F.col("entity")).alias("entity"), F.when(found, "item").otherwise(F.col("outcome")).alias("outcome"), *rest)


def reject_rate(parsed_lines: DataFrame) -> DataFrame:
    return parsed_lines.agg((F.count_if(F.col("outcome") == "reject") / F.count("*")).alias("reject_rate"))
