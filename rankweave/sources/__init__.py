"""Readers that turn raw files, tables and streams into the canonical layout."""
