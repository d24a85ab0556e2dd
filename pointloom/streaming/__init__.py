"""Incremental maps and smoothers."""
