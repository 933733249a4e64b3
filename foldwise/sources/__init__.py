"""Readers and writers: CSV edge, partitioned dataset catalogue, text corpus."""
