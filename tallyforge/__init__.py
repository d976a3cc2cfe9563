"""Spark-native analytics over code-evaluation runs, test suites and chat logs."""
