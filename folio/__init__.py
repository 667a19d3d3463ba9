"""folio: a PySpark-native engine for segmenting, ranking, remembering and auditing long documents."""

__version__ = "0.1.0"
