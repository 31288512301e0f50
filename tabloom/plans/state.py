"""What a preparation learned, and how to apply it again."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession

from tabloom.functions.columns import c
from tabloom.operators.clean import apply_number_format
from tabloom.operators.encode import Levels, apply_levels
from tabloom.operators.impute import Fills, apply_fills
from tabloom.operators.scale import apply_scaler


@dataclass
class PrepState:
    """Bounded facts only: a few numbers or at most 15 levels per column."""

    target: str
    problem_type: str = "classification"
    inputs: dict[str, str] = field(default_factory=dict)
    number_types: dict[str, str] = field(default_factory=dict)
    fills: Fills = field(default_factory=Fills)
    levels: Levels = field(default_factory=Levels)
    scaler: dict[str, tuple[float, float]] = field(default_factory=dict)
    features: list[str] = field(default_factory=list)

    def apply(self, df: DataFrame, keep: list[str] | None = None, scale: bool = True) -> DataFrame:
        """Raw input columns to model features, as projections only.

        The same code serves training and scoring. ``keep`` names further
        columns (key, target) to carry along.
        """
        keep = keep or []
        out = df.select(*[c(n) for n in self.inputs], *[c(n) for n in keep])
        out = apply_number_format(out, {n: t for n, t in self.number_types.items() if n in out.columns})
        out = apply_fills(out, self.fills)
        out = apply_levels(out, self.levels, tail=keep)
        return apply_scaler(out, self.scaler) if scale else out

    def to_frame(self, spark: SparkSession) -> DataFrame:
        """State as rows ``(kind, column, value)``, values in JSON."""
        plain = asdict(self)
        rows = []
        for kind, part in plain.items():
            if isinstance(part, dict) and kind not in ("fills", "levels"):
                rows += [(kind, n, i, json.dumps(v)) for i, (n, v) in enumerate(part.items())]
            else:
                rows.append((kind, None, 0, json.dumps(part)))
        return spark.createDataFrame(rows, "kind string, column string, position long, value string")

    @classmethod
    def from_frame(cls, frame: DataFrame) -> PrepState:
        parts: dict[str, object] = {}
        for r in sorted(frame.collect(), key=lambda r: (r["kind"], r["position"])):
            value = json.loads(r["value"])
            if r["column"] is None:
                parts[r["kind"]] = value
            else:
                parts.setdefault(r["kind"], {})[r["column"]] = value
        parts["fills"] = Fills(**parts["fills"])
        parts["levels"] = Levels(**parts["levels"])
        parts["scaler"] = {n: tuple(v) for n, v in parts.get("scaler", {}).items()}
        return cls(**parts)

    def save(self, spark: SparkSession, path: str) -> None:
        self.to_frame(spark).coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> PrepState:
        return cls.from_frame(spark.read.parquet(path))


