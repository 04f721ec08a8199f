"""DataFrame operators: joins, aggregations, sampling, dictionary, tagging."""
