"""jobs of the image library."""
