"""Dataset-construction and audit operators over DataFrames."""
