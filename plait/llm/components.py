"""Connected components of links between documents or fingerprints: those of the graph engine."""

from plait.operators.stars import components

__all__ = ["components"]
