"""Connected components of a link table (a, b)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from loomgraph.operators import components as library


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node that a link names; root is the smallest node that links reach."""
    return library.components(links, a, b)
