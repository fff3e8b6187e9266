"""Training-data operators.  Nothing outside this package (but the query registry) imports it."""
