"""Part of the audit engine."""
