"""The query builder, scopes, projections and writes."""
