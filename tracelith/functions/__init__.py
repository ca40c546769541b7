"""Part of the tracelith engine."""
