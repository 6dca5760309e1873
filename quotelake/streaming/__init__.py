"""Incremental versions of intake and record keeping."""
