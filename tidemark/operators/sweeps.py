"""Parameter sweeps: choices become variants, variants become rows."""

from __future__ import annotations

import itertools
import re
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _flat(choice: Any) -> list[Any]:
    return [x for c in choice for x in _flat(c)] if isinstance(choice, (list, tuple)) else [choice]


def expanded(choices: dict[str, Any]) -> list[dict[str, Any]]:
    """All combinations, the last parameter fastest; nested choices are flattened; an empty one fails."""
    flat = {k: _flat(v) for k, v in choices.items()}
    if empty := [k for k, v in flat.items() if not v]:
        raise ValueError(f"no choice for {empty}")
    return [dict(zip(flat, values, strict=True)) for values in itertools.product(*flat.values())]


def variants(spark: SparkSession, choices: dict[str, Any]) -> DataFrame:
    """A row for each variant: its parameters, variant (a label of what varies), slug and position."""
    rows = expanded(choices)
    varying = [k for k in choices if len({r[k] for r in rows}) > 1]
    named = [r | {"variant": ", ".join(f"{k}={r[k]}" for k in varying) or "base", "position": i} for i, r in enumerate(rows)]
    return spark.createDataFrame([r | {"slug": re.sub(r"[^a-z0-9]+", "-", r["variant"].lower()).strip("-")} for r in named])


def crossed(df: DataFrame, chosen: DataFrame) -> DataFrame:
    """Every row under every variant; the variants are a short list of one's own."""
    return df.crossJoin(F.broadcast(chosen))
