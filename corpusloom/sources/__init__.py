"""Readers that turn project files and execution records into tables, and the store they are written to."""
