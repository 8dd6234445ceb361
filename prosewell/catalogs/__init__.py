"""Rules, dictionaries and constants as data."""
