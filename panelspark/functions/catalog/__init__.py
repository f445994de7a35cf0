"""Ready-made factors: formulas over a panel's columns, by name."""
