"""Operators over deliveries, players, innings, rankings and venues; each takes and returns DataFrames."""
