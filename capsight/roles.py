"""Column roles shared by every operator."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Roles:
    """Which column plays which part in a table.

    ``group`` may be ``None``: the whole table is then one group.
    ``order_key`` lists extra columns that make the date order total
    (ties on the date are broken by them, never left to file order).
    """

    group: str | None
    date: str
    primary: str
    secondary: str
    order_key: tuple[str, ...] = field(default_factory=tuple)

    def __post_init__(self):
        if self.primary == self.secondary:
            raise ValueError("primary and secondary metric must be different columns")

    @property
    def keys(self) -> list[str]:
        return [self.group] if self.group else []

    def check(self, df: DataFrame) -> "Roles":
        cols = set(df.columns)
        needed = [c for c in (self.group, self.date, self.primary, self.secondary, *self.order_key) if c]
        missing = [c for c in needed if c not in cols]
        if missing:
            raise ValueError(
                f"missing columns {missing}; available: {', '.join(df.columns)}")
        return self


# The canonical roles of a cleaned attendance table.
CANONICAL = Roles(group="Building Name", date="Date", primary="Attendees", secondary="Capacity")
