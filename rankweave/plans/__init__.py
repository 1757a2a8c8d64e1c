"""Signals, their combination, and whole recommendation plans."""
