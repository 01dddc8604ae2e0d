"""Incremental variants on Structured Streaming.

The analytics have no stream semantics of their own (no event-time windows, watermarks or late data), so
nothing here invents them: `lines.append_lines` feeds new line files through the same column functions.
"""
