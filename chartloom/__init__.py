"""chartloom: from line-level clinical notes to scored, evaluated admissions, as Spark plans."""
