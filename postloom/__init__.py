"""A PySpark-native engine for collecting, conforming and analysing job postings."""
