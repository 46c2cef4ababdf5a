"""Streams: the same operators on unbounded tables."""
