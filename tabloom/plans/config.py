"""Settings of one preparation run."""

from __future__ import annotations

from dataclasses import dataclass

from tabloom.operators.impute import STRATEGIES
from tabloom.operators.scale import METHODS

PROBLEM_TYPES = ["auto", "classification", "regression"]


@dataclass(frozen=True)
class PrepConfig:
    """``key`` names the rows and is compared when copies are looked for, unless it is ``excluded`` too."""

    target: str
    excluded: tuple[str, ...] = ()
    key: tuple[str, ...] = ()
    test_size: float = 0.2
    scale_method: str = "standard"
    missing_strategy: str = "auto"
    problem_type: str = "auto"
    scale_on: str = "all"
    seed: int = 42

    def __post_init__(self):
        for value, allowed in (
            (self.scale_method, METHODS),
            (self.missing_strategy, STRATEGIES),
            (self.problem_type, PROBLEM_TYPES),
            (self.scale_on, ["all", "train"]),
        ):
            if value not in allowed:
                raise ValueError(f"{value!r} is not one of {allowed}")
        if not 0 < self.test_size < 1:
            raise ValueError("the test share must lie between 0 and 1")
        if self.target in self.key:
            raise ValueError("the target cannot be part of the row key")
