"""streaming of the image library."""
