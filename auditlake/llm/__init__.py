"""Training-data operators: packing, PII, scoring, de-duplication, language, licences."""
