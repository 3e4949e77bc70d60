"""landgrid: Spark jobs over map tiles, raster cells and land parcels."""
