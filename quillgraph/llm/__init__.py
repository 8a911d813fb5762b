"""Training-data operators over documents and graph text; nothing else in the package imports this subpackage."""
