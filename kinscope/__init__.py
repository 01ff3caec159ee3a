"""kinscope: explainable entity-feature matching and data preparation on PySpark DataFrames."""
