"""Structured Streaming: log lines as typed events, running states and windowed statistics."""
