"""Whole plans: archives, reports, statistics."""
