"""A Spark-native raster datacube: ledgered pixel cells, lazy cleaning and spectral indices."""
