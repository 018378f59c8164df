"""DataFrame-to-DataFrame operators, one concern per module."""
