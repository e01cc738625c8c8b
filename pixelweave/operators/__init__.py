"""operators of the image library."""
