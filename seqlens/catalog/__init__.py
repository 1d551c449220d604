"""Every operator as a runnable query over the given tables, with its SQL oracle."""

from seqlens.catalog import evidence, layout, ranking, review, timeline  # noqa: F401
from seqlens.catalog.base import ORACLES, QUERIES, with_tables

__all__ = ["QUERIES", "oracles"]


def oracles() -> dict[str, str]:
    """Complete SQL per query: the registered text plus the logical tables it names."""
    return {name: with_tables(sql) for name, sql in ORACLES.items()}
