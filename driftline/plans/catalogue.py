"""Every query by name, and its SQL."""

from . import arms, base, draws, market, robust, states, study  # noqa: F401

QUERIES, ORACLES = base.QUERIES, base.ORACLES
