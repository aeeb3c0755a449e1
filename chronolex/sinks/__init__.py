"""Sinks that take effect whole or not at all."""
