"""Reading and writing: JSON lines, compressed JSON, PDF files, catalogs, settings."""
