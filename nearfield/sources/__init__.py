"""Vector files: binary matrices, per-row binary vectors and text."""
