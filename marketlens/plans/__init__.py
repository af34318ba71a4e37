"""Queries over the test tables; importing this package registers all of them."""

from marketlens.plans import alarms, archive, cohort, market, outcomes, paper, policy, streams, wallets  # noqa: F401
from marketlens.registry import ORACLES, QUERIES, SERVES  # noqa: F401
