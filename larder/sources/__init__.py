"""Repository formats: readers of files, parsers of records, and the load path to packages."""
