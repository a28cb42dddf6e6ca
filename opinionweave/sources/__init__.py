"""Schemas, tenant-scoped tables, landing readers and sinks."""
