"""Parameters of the daily study; every length counts rows of the target's calendar."""

from __future__ import annotations

from dataclasses import dataclass


# Lengths, delays and penalties that results depend on.
@dataclass(frozen=True)
class Params:
    window: int = 5
    horizon: int = 5
    median: int = 252
    min_periods: int = 30
    train: int = 1250
    val: int = 250
    refit: int = 21
    delays: tuple[int, ...] = (0, 1, 2, 3, 5, 8, 13, 21, 34, 55)
    lambdas: tuple[float, ...] = (0.3, 1.0, 3.0, 10.0, 30.0)
    min_train: int = 200
    block: int = 40
    block_cap: int = 80

    @property
    def span(self) -> int:
        """Rows that a refit may train on."""
        return self.train + self.val

    def block_for(self, delay: int) -> int:
        """Truncation length of a delay."""
        return min(self.block + delay, self.block_cap)


#: For the derived series, which keep no memory beyond a week.
SHORT = Params(horizon=1, median=60, train=250, val=50, delays=(0, 1, 2, 3))
