"""Streaming form of scoring: new essay files scored as they arrive."""
