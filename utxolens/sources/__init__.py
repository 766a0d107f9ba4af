"""Reading, writing and intermediate storage."""
