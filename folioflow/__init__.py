"""Part of folioflow, a Spark-native document analytics engine."""
