"""Import every module that registers queries."""

from catalog import columns, entities, learning, prepare, profile, risk, teams  # noqa: F401
