"""Movie and trace analytics on Spark: images, factorisation, deconvolution, quality, registration."""
