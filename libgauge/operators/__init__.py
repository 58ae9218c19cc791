"""DataFrame to DataFrame operators without actions or Python functions."""
