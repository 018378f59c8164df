"""Jobsight streaming."""
