"""A PySpark-native event-study engine over time-ordered bars."""
