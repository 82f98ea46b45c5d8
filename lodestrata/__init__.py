"""An evidence-to-signal analytics engine on Spark DataFrames."""
