"""Training-data operators: search, archives, scans, classifiers, deduplication and tokenization."""
