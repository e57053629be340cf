"""All plan modules of the core."""

from driftline.plans import generic, linking, nights, orbits, training, trajectories, values

FLAGSHIP = "intra_pairs_mag"
MODULES = [training, linking, trajectories, orbits, generic, values, nights]
