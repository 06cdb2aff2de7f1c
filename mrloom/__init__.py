"""Spark-native analytics over MR header tables, and corpus operators in `mrloom.llm`."""
