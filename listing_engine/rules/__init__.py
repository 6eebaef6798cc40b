"""Fixed dictionaries of the domain, as plain data."""
