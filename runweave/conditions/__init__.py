"""The language of start conditions: parsing, evaluation, references."""
