"""sigframe: cataloguing, cleaning, segmenting and exporting large collections of
multi-channel recordings, expressed as Spark DataFrame algebra."""

__version__ = "0.1.0"
