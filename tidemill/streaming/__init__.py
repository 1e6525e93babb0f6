"""The stateless operators over streams, and running summaries with watermarks."""
