"""Operators: lazy ``DataFrame(s) -> DataFrame`` functions."""
