"""cellshift: perturbation-response benchmarking as Spark jobs."""

__version__ = "0.1.0"
