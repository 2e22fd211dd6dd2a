"""Keeping a partitioned item table up to date from a folder of item files."""

from skylattice.streaming.sync import sync_available

__all__ = ["sync_available"]
