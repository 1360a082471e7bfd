"""Rules as plans: structure, refinement, fingerprints and compilation to DataFrames."""
