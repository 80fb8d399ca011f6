"""capturelake: Spark jobs for large collections of handheld 3D-capture sessions."""

__version__ = "0.1.0"
