"""quern: a PySpark-native analytics engine for command-output text and its history."""
