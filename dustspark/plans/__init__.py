"""Reports, model plans and the query catalog."""
