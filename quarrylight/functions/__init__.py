"""Column functions: text, URL, name, number and hash expressions."""
