"""Identity resolution and interval planning over detection and embedding tables, on Spark."""
