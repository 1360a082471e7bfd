"""Operators over knowledge bases: storage, scoring, search, analysis, compression and recovery."""
