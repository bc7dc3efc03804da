"""Structured Streaming: watermarked windows and running votes."""
