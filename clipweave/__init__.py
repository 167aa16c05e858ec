"""A PySpark-native engine for curating large collections of time-stamped, scored segments."""
