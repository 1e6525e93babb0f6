"""Plans made of operators: extraction, resolution, validation, XML, approval, and the query catalogue."""
