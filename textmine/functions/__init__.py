"""Column-level helpers: regex specs, glob translation and fixed lexicons."""
