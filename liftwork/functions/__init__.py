"""Column functions: hash uniforms, link functions, effect arithmetic, tags and small statistics."""
