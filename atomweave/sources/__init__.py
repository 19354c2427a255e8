"""Readers, sinks, adapters of the driver's tables and the element table."""
