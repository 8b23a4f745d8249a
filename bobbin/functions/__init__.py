"""Functions of stitch, artwork and catalogue tables."""
