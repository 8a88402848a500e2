"""Speech and spoken-language dataset analytics on PySpark DataFrames."""
