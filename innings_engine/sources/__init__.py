"""Readers, writers and the delivery log built from the bundled tables."""
