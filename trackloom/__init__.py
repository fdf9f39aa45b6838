"""Spark-native tracking and dataset analytics."""
