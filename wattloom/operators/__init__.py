"""Operators on readings: DataFrames of (channel, pos, ts, value)."""
