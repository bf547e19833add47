"""Part of brackwater; see the modules of this folder."""
