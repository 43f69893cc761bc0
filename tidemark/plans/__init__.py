"""Registered queries of the event-study engine."""
