"""Training-data operators: one module each, all plain DataFrame in, DataFrame out."""
