"""Text retrieval and text analytics as DataFrame algebra."""
