"""Streams: document stages as keyed state with timers, and result files as they appear."""
