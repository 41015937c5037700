"""Dataset operators: profiling, search, paging, inspection, schema checks."""
