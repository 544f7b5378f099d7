"""Spark-native analytics for collections of compounds, spectra and peak lists."""
