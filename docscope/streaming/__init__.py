"""Streaming forms of the replay join and of running outcome counts."""
