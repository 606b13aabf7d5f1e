"""quire: scholarly-document analytics as DataFrame plans."""
