"""All registered queries and their SQL."""

from __future__ import annotations

from plumbline.plans import answers, evidence, files, judged, judging, pairing  # noqa: F401  they register their queries
from plumbline.plans.registry import ORACLES, QUERIES


def queries():
    return QUERIES


def oracle_sql():
    return ORACLES
