"""Accessibility and movement-flow analytics on spatial networks, as Spark plans."""

__version__ = "0.1.0"
