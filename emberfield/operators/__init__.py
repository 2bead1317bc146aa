"""DataFrame operators, grouped as cleaning, categories, joins, reshaping, windows and summaries."""
