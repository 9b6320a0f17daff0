"""Operators of a training-data pipeline over ``documents``; their runnable queries are in ``queries``."""
