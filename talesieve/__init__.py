"""talesieve: analytics over serialised long-form text, expressed as Spark plans."""
