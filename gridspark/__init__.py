"""gridspark: gridded environmental data on Spark. Cells, points and polygons are ordinary DataFrames."""
