"""Spark jobs over tables of crawled pages and agent sessions."""
