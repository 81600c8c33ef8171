"""Scalar functions: from typed SQL fragments to a typed SQL fragment."""

from nestq.functions.scalar import FUNCTIONS

__all__ = ["FUNCTIONS"]
