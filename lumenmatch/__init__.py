"""Few-shot content matching on Spark: banks of reference vectors scored against large target tables."""
