from .numbers import half_even, half_up, to_number
from .text import absolute_link, normalize_text, or_default, repair_text, uuid5_dns
from .vectors import cosine, dot, flat_vector, norm

__all__ = [
    "absolute_link", "cosine", "dot", "flat_vector", "half_even", "half_up", "norm",
    "normalize_text", "or_default", "repair_text", "to_number", "uuid5_dns",
]
