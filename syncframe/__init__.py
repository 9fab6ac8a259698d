"""File inventories, chunk catalogues, mirror plans, integrity and transfer events as Spark DataFrames."""
