"""Training-data operators: one module each, queries and oracles in ``queries``."""
