"""Readers and writers: tables, chat logs, envelopes, key-value logs."""
from .tables import table

__all__ = ["table"]
