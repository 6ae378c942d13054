"""Plans: end-to-end jobs (instant / full analysis) and the query registry."""
