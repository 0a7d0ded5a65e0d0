"""Work-log folds, windows and incremental ingest."""
