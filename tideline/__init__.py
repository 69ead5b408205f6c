"""tideline: a Spark-native analytics engine for bounded-match event logs."""
