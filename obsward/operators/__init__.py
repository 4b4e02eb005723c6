"""Quality checks and spatial operators on DataFrames of stations."""
