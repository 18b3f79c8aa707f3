"""Structured Streaming: stateful processors and native event-time windows."""
