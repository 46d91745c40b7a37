"""Structured Streaming jobs. Both are stateless per row: no watermark is needed."""
