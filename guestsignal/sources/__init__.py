"""Readers, writers and the stored tables of a finished run."""
