"""residua: PySpark-native analytics for molecular trajectories and residue contacts."""
