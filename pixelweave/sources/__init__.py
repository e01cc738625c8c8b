"""sources of the image library."""
