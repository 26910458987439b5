"""Part of convlake."""
