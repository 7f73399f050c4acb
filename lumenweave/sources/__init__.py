"""Readers of crawls: JSON dumps, tables of extracted pages, and raw HTML."""
