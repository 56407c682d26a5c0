"""Document-analytics engine on PySpark: blocks, sections, interval trees, curation and export plans."""

__version__ = "0.1.0"
