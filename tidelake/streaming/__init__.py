"""Streams into tables and windowed counts over streams."""

from tidelake.streaming.tables import sessions, sliding, stream_into, tumbling

__all__ = ["sessions", "sliding", "stream_into", "tumbling"]
