"""The question put to a table."""
from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Spec:
    """``y`` compared over / against ``group``; ``by`` adds one result row per level."""

    y: str
    group: str | None = None
    question: str = "Q-01"
    event: str | None = None
    by: str | None = None
    subject: str | None = None
    paired: bool = False
    direction: str = "two-sided"          # or greater / less
    control: str | None = None
    weights: tuple[float, ...] | None = None
    members: tuple[str, ...] = ()         # composition members
    levels: tuple[str, ...] | None = None
    n_tests: int = 1
    options: dict = field(default_factory=dict)
