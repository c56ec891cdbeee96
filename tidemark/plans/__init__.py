"""Registry of all queries. Each module keeps a query next to its SQL twin."""

from importlib import import_module

_MODULES = ("commerce", "ingest", "logs", "traces", "retrieval", "corpus", "streaming")


def _merged(attribute: str) -> dict:
    merged: dict = {}
    for name in _MODULES:
        merged.update(getattr(import_module(f"tidemark.plans.{name}").register, attribute))
    return merged


def all_queries() -> dict:
    return _merged("queries")


def all_oracles() -> dict:
    return _merged("oracles")


def load(spark, sf: str) -> None:
    """Build the tables that queries share (funnel, triples, chunk index), as loading the data would."""
    from tidemark.plans import commerce, corpus, retrieval
    commerce._funnel(spark, sf)
    corpus._triples(spark, sf)
    retrieval._index(spark, sf)
