"""voxelmill: Gaussian-splat fields, iso-surfaces and meshes as Spark DataFrames."""
