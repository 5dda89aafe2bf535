from tastewright.functions.text import (
    bullet_list,
    csv_fields,
    csv_struct,
    has_prefix,
    naive_fields,
    required,
    to_int,
    to_number,
)
from tastewright.functions.vectors import dot, random_unit_vector

__all__ = [
    "bullet_list",
    "csv_fields",
    "dot",
    "has_prefix",
    "naive_fields",
    "random_unit_vector",
    "required",
    "to_int",
    "to_number",
]
