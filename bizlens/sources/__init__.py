"""Where the tables come from: files in and out, and views over the base tables."""
