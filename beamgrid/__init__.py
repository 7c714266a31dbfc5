"""beamgrid: ray clouds as Spark DataFrames, with lazily composed spatial operators."""
