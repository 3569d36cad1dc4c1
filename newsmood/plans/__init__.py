"""Registered queries over the test tables."""


def load_all() -> dict:
    """Imports every query module and returns the registry."""
    from newsmood.plans import briefs, evaluation, ingest, mood, reads, scoring, streams  # noqa: F401
    from newsmood.plans.registry import QUERIES

    return QUERIES
