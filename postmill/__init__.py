"""Spark-native intake and tracking of postings: discovery, keyed upserts,
a retry-aware fetch lifecycle, page parsing, batch scoring and write-back."""
