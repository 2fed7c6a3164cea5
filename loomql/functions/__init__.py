"""JSON projections and values, conversions between rows and objects."""
