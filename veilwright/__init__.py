"""veilwright: finding, reviewing and redacting sensitive data in large document tables with Spark."""
