"""Functions of the raster and photometric engine."""
