"""Operators for preparing training text at scale: one module per operator.

Nothing else in the library imports this subpackage. ``queries`` holds the registered
queries and their SQL; ``stages`` the steps of the corpus pipeline.
"""
