"""Runloom: Spark-native preparation of fine-tuning data and analysis of training runs."""
