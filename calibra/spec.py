"""Feature specification passed to every operator (no module globals)."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class FeatureSpec:
    """Which columns are the key, numeric features, categoricals and target.

    Order matters: encoded output columns follow ``numeric`` then the dummies of
    ``categorical`` in the order given here.
    """

    key: str
    numeric: tuple[str, ...]
    categorical: tuple[str, ...] = field(default_factory=tuple)
    target: str = "y"

    @property
    def features(self) -> tuple[str, ...]:
        return tuple(self.numeric) + tuple(self.categorical)
