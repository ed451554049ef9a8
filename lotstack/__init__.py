"""Spark-native analytics for three-dimensional land-parcel data."""
