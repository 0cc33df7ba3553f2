"""Spark-native analytics over record tables, time series and long documents."""
