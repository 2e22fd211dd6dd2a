"""Registered queries of the engine, and the same in SQL."""
