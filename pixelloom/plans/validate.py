"""Checks of parameters: each raises ValueError with the parameter's name."""

from __future__ import annotations

from pixelloom.model import DTYPES


def window_size(value: int | tuple[int, int] | None, cog: bool = False) -> None:
    if value is not None and not (isinstance(value, int) and value > 0 or isinstance(value, tuple) and len(value) == 2 and all(isinstance(v, int) and v > 0 for v in value)):
        raise ValueError("window_size is None, a positive int or a pair of them")
    if cog:
        w, h = (value, value) if isinstance(value, int) else value or (0, 1)
        if w != h or w % 16:
            raise ValueError("a tiled file needs a square window_size that is a multiple of 16")


def dtype(value: str | None) -> None:
    if value is not None and value not in DTYPES:
        raise ValueError(f"output_dtype is None or one of {', '.join(DTYPES)}")


def nodata(value: float | None) -> None:
    if value is not None and (isinstance(value, bool) or not isinstance(value, (int, float))):
        raise ValueError("custom_nodata is None or a number")


def vector_mask(value: tuple | None) -> None:
    if value is not None and not (isinstance(value, tuple) and len(value) in (2, 3) and value[0] in ("include", "exclude") and all(isinstance(v, str) for v in value[2:])):
        raise ValueError("vector_mask is None or (include | exclude, features[, field])")


def factors(mean: float, std: float) -> None:
    for name, v in (("mean_factor", mean), ("std_factor", std)):
        if isinstance(v, bool) or not isinstance(v, (int, float)) or v < 0:
            raise ValueError(f"{name} is a number of 0 or more")


def model_images(value: tuple | None) -> None:
    if value is not None and not (isinstance(value, tuple) and len(value) == 2 and value[0] in ("include", "exclude") and isinstance(value[1], (list, tuple)) and all(isinstance(v, str) for v in value[1])):
        raise ValueError("model_images is None or (include | exclude, [names])")


def blocks(number: int | tuple[int, int] | str, alpha: float, method: str, threshold: float, canvas: tuple | None) -> None:
    if not (isinstance(number, int) and number > 0 or isinstance(number, tuple) and len(number) == 2 and all(isinstance(v, int) and v > 0 for v in number) or number == "coefficient_of_variation"):
        raise ValueError("number_of_blocks is a positive int, (rows, columns) or coefficient_of_variation")
    if isinstance(alpha, bool) or not isinstance(alpha, (int, float)):
        raise ValueError("alpha is a number")
    if method not in ("gamma", "linear"):
        raise ValueError("correction_method is gamma or linear")
    if not isinstance(threshold, (int, float)) or not 0 <= threshold <= 1:
        raise ValueError("block_valid_pixel_threshold is between 0 and 1")
    if canvas is not None and not (len(canvas) == 4 and canvas[0] < canvas[2] and canvas[1] < canvas[3]):
        raise ValueError("override_bounds is (x_min, y_min, x_max, y_max)")
