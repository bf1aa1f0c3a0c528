"""A PySpark-native engine for asset catalogs: hybrid ranked retrieval, catalog and queue analytics, reconciliation."""
