"""A library of Spark-native data-processing operators."""
