"""provgraph: provenance graphs and corpus preparation on PySpark DataFrames."""
