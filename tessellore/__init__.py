"""tessellore: analytics over citable document libraries, declared as Spark plans."""
