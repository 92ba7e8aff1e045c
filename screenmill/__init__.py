"""Spark jobs for regulatory document screening."""
