"""Column expressions and array functions."""

from obsward.functions.arrays import compute_quantile, find_k_closest, subset, unsubset
from obsward.functions.geo import calc_distance, calc_distance_fast, calc_distance_xyz, chord, convert_coordinates, deg2rad, rad2deg, xyz
from obsward.functions.validity import clean, is_valid, param

__all__ = ["calc_distance", "calc_distance_fast", "calc_distance_xyz", "chord", "clean", "compute_quantile", "convert_coordinates", "deg2rad", "find_k_closest", "is_valid", "param", "rad2deg", "subset", "unsubset", "xyz"]
