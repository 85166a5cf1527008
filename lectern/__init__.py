"""Spark-native engine for ranking new papers and checking claims against evidence."""
