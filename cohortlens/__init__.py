"""PySpark-native analytics for per-chromosome scoring of sequencing cohorts."""
