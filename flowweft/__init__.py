"""flowweft: data-flow graph analytics as Spark DataFrame jobs."""

from .runtime import configure, materialize

__all__ = ["configure", "materialize"]
