"""Independent SQL for every registered query, over the sample tables."""

from oracle.build import statements

__all__ = ["statements"]
