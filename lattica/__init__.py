"""Lattica: PySpark-native analytics on periodic scalar fields, token rows and the tables around them."""
