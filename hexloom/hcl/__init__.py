"""The configuration language: parsing, partial evaluation, rendering."""
