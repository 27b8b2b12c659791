"""DataFrame operators: filters, joins, aggregations, windows, graphs and planning."""
