"""Reading and writing the lake: day partitions, typed views, CSV files."""
