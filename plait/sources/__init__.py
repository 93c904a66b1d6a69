"""Reading and writing graphs: GFA text and Parquet stores."""
