"""Structured Streaming forms of the trace operators; the batch operators stay the reference for complete data."""

from .brackets import bracket_rows, open_brackets, pair_trigger, start_brackets
from .spans import dedupe_stream, link_stream, run_available

__all__ = ["dedupe_stream", "link_stream", "bracket_rows", "open_brackets", "pair_trigger", "start_brackets", "run_available"]
