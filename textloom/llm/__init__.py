"""Training-data operators: one module for each, general interfaces; ``queries`` holds the registered queries."""
