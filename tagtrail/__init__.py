"""tagtrail: a Spark-native index of the releases of a source tree."""
