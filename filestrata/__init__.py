"""Corpus analytics over tables of files, expressed as Spark DataFrame jobs."""
