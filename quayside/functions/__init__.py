from .hashing import md5_bucket, md5_uniform, md5_u32
from .literals import array_literal
from .vectors import argmax_label

__all__ = ["md5_bucket", "md5_uniform", "md5_u32", "array_literal", "argmax_label"]
