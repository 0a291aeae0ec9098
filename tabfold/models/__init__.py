"""Classifiers and calibration on pyspark.ml."""
