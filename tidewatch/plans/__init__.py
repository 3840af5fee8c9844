"""Operators composed into whole analyses, and the queries registered from them."""
