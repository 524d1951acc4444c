"""Patterns over triples that arrive: the compiled operators are ones that Structured Streaming supports."""
