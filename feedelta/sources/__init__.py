"""Feed discovery (directory, zip, HTTP folder) and CSV ingestion."""
