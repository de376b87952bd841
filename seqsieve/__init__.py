"""Spark-native screening of sequence-variant tables."""
