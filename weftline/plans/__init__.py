"""Registered queries over the reference capabilities, each with the SQL it is held against."""
