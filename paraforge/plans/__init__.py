"""Planning before a scan: which columns and nested fields are read."""
