"""Readers of frames and images, and the sinks of a run."""
