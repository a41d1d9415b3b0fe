"""Read files in and out."""
