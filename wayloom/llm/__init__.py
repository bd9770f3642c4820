"""Training-data operators: one module for each, none imported by the graph library."""
