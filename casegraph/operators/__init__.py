"""Operators over tables of documents and cases."""
