"""Training-data operators: ten whole-corpus jobs and their queries."""
