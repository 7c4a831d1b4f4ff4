"""Spark-native dataset curation and detector evaluation."""
