"""Readers, writers, intake and the parser of regulation XML."""
