"""zonedeck: fixed-layout host record analytics on PySpark."""
