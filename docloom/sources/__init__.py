"""Files in and out, and small readers of file formats."""
