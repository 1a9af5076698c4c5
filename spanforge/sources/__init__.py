"""Sources: raw pages and files to blocks and lines."""
