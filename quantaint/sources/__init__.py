"""Reading and writing tables, violation sets and scores."""
