"""Readers, dimension tables and the derived star schema."""
