"""All core queries and their SQL."""

from __future__ import annotations

from marlstone.plans import connectors, evaluation, messages, preparation

QUERIES = {**preparation.QUERIES, **messages.QUERIES, **evaluation.QUERIES, **connectors.QUERIES}
ORACLES = {**preparation.ORACLES, **messages.ORACLES, **evaluation.ORACLES, **connectors.ORACLES}
