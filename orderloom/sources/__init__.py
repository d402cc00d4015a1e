"""Reading, writing and naming of tables."""
