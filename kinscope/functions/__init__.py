"""Part of kinscope."""
