"""Part of tideline; see the modules."""
