"""Part of the document-archive analytics engine."""
