"""Structured Streaming variants of intake, timeline, alert state, sessions,
triage and case state."""
