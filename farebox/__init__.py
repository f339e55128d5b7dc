"""Farebox: Spark-native analytics for public-transport timetables, card taps and route choice."""
