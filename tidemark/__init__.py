"""Versioned key-value analytics on PySpark: mutation logs, newest-wins resolution, levelled compaction."""
