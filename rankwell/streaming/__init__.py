"""The anytime answer over a stream."""
