"""Readers and writers of the formats that Spark does not read by itself."""
