"""Scans, sinks and data contracts."""
