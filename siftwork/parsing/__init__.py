"""Generalised LL recognition of source files, used inside Spark tasks."""
