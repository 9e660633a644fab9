"""Scalar functions (Column -> Column).  All are built-in Spark expressions,
so they stay inside whole-stage code generation."""

from .scalars import *  # noqa: F401,F403
from .scalars import __all__  # noqa: F401
