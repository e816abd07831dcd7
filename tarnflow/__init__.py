"""A PySpark-native engine for daily time series, catchments and training-data corpora."""
