"""Query registry, workspace and session helpers."""
