"""Readers and flatteners for files, game logs and nested feeds."""
