"""Corpus-preparation operators: each module holds one operator, written as Spark jobs."""
