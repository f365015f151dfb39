"""Plan-shape helpers: size-checked broadcasts, checkpoints, distributed ordering."""
