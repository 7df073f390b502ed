"""Registered queries and their oracle SQL."""

from platen.plans import decide, measure, pages, records

QUERIES: dict = {**measure.QUERIES, **decide.QUERIES, **records.QUERIES, **pages.QUERIES}
ORACLES: dict = {**measure.ORACLES, **decide.ORACLES, **records.ORACLES, **pages.ORACLES}
