"""Transform, maxima, ridges, moments, spectra, Hurst exponent and pixels."""
