"""Outcome tables, images and made-up outcomes to read; curves and summaries to write."""
