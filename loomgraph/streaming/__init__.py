"""Watching for changes."""
