"""Structured Streaming: fitted transforms and models applied to streams."""
