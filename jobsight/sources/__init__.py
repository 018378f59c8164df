"""Jobsight sources."""
