"""Reading and writing of records, pairs, scores and models."""
