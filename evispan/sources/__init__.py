"""Files and tables in, located chunks and index tables out."""
