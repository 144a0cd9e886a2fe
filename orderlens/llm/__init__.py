"""Operators that prepare training data for language models, each as one Spark job."""
