"""Jobs for large collections of parsed documents on Spark."""
