"""The same bars and order states on streams of events."""
