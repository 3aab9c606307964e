"""Reading and writing the binary log."""
