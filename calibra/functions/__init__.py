from calibra.functions.hashing import hash_hex, hash_uniform
from calibra.functions.scalar import clip, fmt_num, safe_div, sigmoid

__all__ = ["hash_hex", "hash_uniform", "clip", "fmt_num", "safe_div", "sigmoid"]
