"""Rules, validation, grouping, scoring, semantic and enrichment stages over crawl tables."""
