"""marlstone: versioned key-value, vector and replication-log analytics on PySpark."""

__version__ = "0.1.0"
