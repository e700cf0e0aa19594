"""Evidence graphs from tables, and the catalogue of queries over them."""
