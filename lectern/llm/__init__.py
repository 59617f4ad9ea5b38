"""Training-data operators: ten components for corpora of any size, and their registered queries."""
