"""tessera: DataFrame operators for text corpora, retrieval, conversation logs and telemetry."""

__version__ = "0.1.0"
