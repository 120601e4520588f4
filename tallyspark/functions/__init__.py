"""Column helpers: money, text, dates, vectors and the few Arrow UDFs."""
