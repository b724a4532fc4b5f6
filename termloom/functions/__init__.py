from termloom.functions.scalars import (
    angular_label,
    angular_labels,
    capacity,
    is_ascii,
    is_oversize,
    is_too_long,
    kappa_squared,
    occupation_fraction,
    strict_int,
    truncate_line,
    two_j,
)

__all__ = [
    "angular_label",
    "angular_labels",
    "capacity",
    "is_ascii",
    "is_oversize",
    "is_too_long",
    "kappa_squared",
    "occupation_fraction",
    "strict_int",
    "truncate_line",
    "two_j",
]
