"""Operators of a training-data pipeline over the tables documents, pages and conversations; nothing else in the library imports them."""
