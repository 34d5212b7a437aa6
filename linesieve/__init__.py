"""Security scanning of code, text and configuration tables on Spark."""
