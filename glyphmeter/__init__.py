"""Spark-native analytics for transcription quality: text metrics, rankings, statistics and history."""
